import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage import LoadSpec, load_all
from haulage.functions.types import ValueRules, landing_schema
from haulage.operators import quality
from haulage.operators.conform import conform, with_defaults
from haulage.plans import banking
from tests.conftest import rows

ARRIVES = {
    "integer": "int", "smallint": "int", "bigint": "bigint", "real": "float",
    "double precision": "double", "numeric": "decimal(15,2)", "text": "string",
    "character varying": "string", "character": "string", "boolean": "boolean", "date": "date",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp",
    "uuid": "string", "inet": "string", "jsonb": "string", "array": "array<string>",
    "bytea": "binary", "interval": "string", "time without time zone": "timestamp_ntz",
}

USER = dict(
    user_id=1, first_name="Ada", last_name="Byron", email="ada@example.org", phone="1",
    date_of_birth=dt.date(1990, 1, 1), ssn="123-45-6789", address="1 Road", city="Town",
    state="NY", zip_code="10001", account_type="savings", account_number="ACC0000000001",
    balance=Decimal("100.00"), credit_score=700, is_active=True,
    created_at=dt.datetime(2020, 1, 1), last_login=dt.datetime(2024, 1, 10),
)
LOAN = dict(
    loan_id=1, user_id=1, account_id=2**53 + 1, loan_type="auto", principal_amount=Decimal(15_000),
    outstanding_balance=Decimal(0), interest_rate=Decimal("7.2"), term_months=60,
    monthly_payment=Decimal("1.92"), grace_period="30 days",
    payment_due_time=dt.datetime(1970, 1, 1, 9), origination_date=dt.date(2020, 1, 1),
    maturity_date=dt.date(2024, 12, 5), next_payment_date=None, status="paid_off",
    collateral_desc="a car", created_at=None, updated_at=None,
)


def schema(table):
    return T.StructType.fromDDL(
        ", ".join(f"{c.name} {ARRIVES[c.source_type]}" for c in banking.source_columns(table))
    )


def frame(spark, table, *records):
    columns = [c.name for c in banking.source_columns(table)]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in records], schema(table))


def broken(df, table, as_of=None):
    return [r[0] for r in quality.judged(df, banking.all_rules(table, as_of)).select("broken_rules").collect()]


@pytest.mark.parametrize("table", list(banking.COLUMNS))
def test_an_empty_table_loads_with_its_schema(spark, tables, table):
    df, columns = frame(spark, table), banking.source_columns(table)
    declared = landing_schema(columns, ValueRules(), df.schema)
    tables.write(conform(df, columns), f"banking.{table}", schema=declared)
    assert tables.schema(f"banking.{table}") == declared
    assert tables.read(f"banking.{table}").count() == 0


SAMPLES = {
    "integer": 1, "smallint": 1, "bigint": 1, "numeric": Decimal(1), "character": "x",
    "character varying": "x", "uuid": "u", "date": dt.date(2024, 1, 1), "boolean": True,
    "timestamp without time zone": dt.datetime(2024, 1, 1),
    "timestamp with time zone": dt.datetime(2024, 1, 1),
}


@pytest.mark.parametrize("table", list(banking.COLUMNS))
def test_null_wherever_it_is_allowed_and_only_there(spark, tables, table):
    columns = banking.source_columns(table)
    needed = {c.name: SAMPLES[c.source_type] for c in columns if not c.nullable}
    landed = conform(frame(spark, table, needed), columns).first().asDict()
    assert {name for name, value in landed.items() if value is not None} == set(needed)
    for name in needed:
        bare = frame(spark, table, {**needed, name: None})
        with pytest.raises(Exception, match=f"column {name} must not be NULL"):
            conform(bare, columns).collect()


def test_a_good_user_breaks_nothing(spark):
    as_of = F.lit("2024-01-15").cast("date")
    assert broken(frame(spark, "users", USER), "users", as_of) == [[]]


def test_a_bad_user_is_told_everything(spark):
    bad = {
        **USER, "email": "ADA", "ssn": "123456789", "state": "New", "balance": Decimal(-1),
        "credit_score": 200, "account_type": "cash", "date_of_birth": dt.date(2020, 1, 1),
        "first_name": None, "account_number": "1",
    }
    names = broken(frame(spark, "users", bad), "users", F.lit("2024-01-15").cast("date"))[0]
    assert names == [
        "first_name is present", "state fits", "email has @", "email is lower case",
        "ssn is 11 long", "ssn has two dashes", "state is 2 long", "account type is known",
        "account number is 10 to 20 long", "balance is not negative",
        "credit score is 300 to 850", "age is 18 to 80",
    ]


def test_loans_land_and_check(spark, tables):
    df, columns = frame(spark, "loans", LOAN), banking.source_columns("loans")
    landed = conform(df, columns, ValueRules(exact_decimal=True)).first()
    assert landed.grace_period == "2592000000000000" and landed.payment_due_time == "09:00:00.000000"
    assert landed.account_id == 2**53 + 1 and landed.interest_rate == Decimal("7.200")
    assert broken(df, "loans") == [[]]
    bad = {**LOAN, "outstanding_balance": Decimal(5), "loan_type": "student", "maturity_date": LOAN["origination_date"]}
    assert broken(frame(spark, "loans", bad), "loans") == [
        ["maturity follows origination", "paid off loans owe nothing", "collateral only where secured"]
    ]
    for amount, wrong in ((14_999, True), (60_000, False), (60_001, True)):
        loan = frame(spark, "loans", {**LOAN, "principal_amount": Decimal(amount)})
        assert broken(loan, "loans") == [["principal fits the loan type"] * wrong]


def test_merchants_and_audit_rows_land_as_text(spark):
    merchant = dict(
        merchant_id=1, merchant_uuid="u", name="m", category="fuel", country="US",
        tags=["online", None], metadata='{"preferred": true}', onboarded_on=dt.date(2024, 1, 1),
    )
    df = frame(spark, "merchants", merchant)
    assert conform(df, banking.source_columns("merchants")).first().tags == '["online",null]'
    audit = dict(
        audit_id=1, event_uuid="u", entity_type="user", entity_id=2**53 + 1, action="failed_login",
        session_token=b"\xff\xfe\x00", ip_address="::1", succeeded=True,
        occurred_at=dt.datetime(2024, 1, 1, 12),
    )
    df = frame(spark, "audit_log", audit)
    landed = conform(df, banking.source_columns("audit_log")).first()
    assert landed.session_token == "\\xfffe00" and landed.entity_id == 2**53 + 1
    assert broken(df, "audit_log") == [["failed logins did not succeed"]]


@pytest.mark.parametrize("table", list(banking.COLUMNS))
def test_defaults_are_columns_of_the_table(spark, table):
    defaults = banking.defaults(table)
    assert set(defaults) <= set(banking.COLUMNS[table])
    filled = with_defaults(spark.range(1), defaults)
    assert set(filled.columns) == {"id", *defaults} and filled.count() == 1


def test_keys_are_reported(spark):
    users = frame(spark, "users", USER, {**USER, "user_id": 2, "ssn": None}, {**USER, "user_id": 3, "ssn": None})
    loans = frame(spark, "loans", LOAN, {**LOAN, "loan_id": 2, "user_id": 9})
    report = dict(rows(banking.key_report({"users": users, "loans": loans})))
    assert report["users.email is unique"] == 2 and report["users.ssn is unique"] == 0
    assert report["loans.user_id exists in users"] == 1 and report["loans.loan_id is unique"] == 0


def test_deleting_a_user(spark):
    tables = {
        "users": frame(spark, "users", USER),
        "loans": frame(spark, "loans", LOAN),
        "audit_log": frame(spark, "audit_log", dict(audit_id=1, user_id=1)),
    }
    after = banking.delete_users(tables, F.col("user_id") == 1)
    assert after["users"].count() == after["loans"].count() == 0
    assert rows(after["audit_log"], "audit_id", "user_id") == [(1, None)]


def test_replay_starts_from_the_users_balance(spark):
    users = frame(spark, "users", USER)
    moves = [("fee", 30), ("payment", 100), ("interest", 50), ("transfer", 20)]
    transactions = frame(
        spark, "transactions",
        *[dict(transaction_id=i, user_id=1, transaction_type=k, amount=Decimal(a), balance_after=Decimal(0))
          for i, (k, a) in enumerate(moves)],
    )
    replayed = banking.replay_transactions(transactions, users).orderBy("transaction_id")
    assert [r.balance_after for r in replayed.collect()] == [70, 0, 50, 30]


def test_transactions_find_their_merchant_by_name(spark):
    transactions = frame(
        spark, "transactions",
        dict(transaction_id=1, merchant="Fuel Co"), dict(transaction_id=2, merchant="Unknown"),
        dict(transaction_id=3),
    )
    merchants = frame(spark, "merchants", dict(merchant_id=9, name="Fuel Co", category="fuel"))
    found = rows(banking.with_merchants(transactions, merchants), "transaction_id", "merchant_id")
    assert found == [(1, 9), (2, None), (3, None)]


def test_all_six_tables_load_in_order(spark, tables, tmp_path):
    specs = {}
    for table in banking.COLUMNS:
        path = str(tmp_path / table)
        record = {"users": USER, "loans": LOAN}.get(table)
        frame(spark, table, *([record] if record else [])).write.parquet(path)
        columns = banking.source_columns(table)
        parents = tuple({fk.parent for fk in banking.FOREIGN_KEYS if fk.child == table})
        specs[table] = LoadSpec(
            table, path=path, namespace="banking", depends_on=parents,
            column_types={c.name: c.source_type for c in columns},
            not_null=tuple(c.name for c in columns if not c.nullable),
        )
    report = load_all(spark, specs, tables).collect()
    assert sum(row.rows_loaded for row in report) == 2 and len(report) == 6
    assert tables.read("banking.loans").first().grace_period == "2592000000000000"
    tables.drop(*[f"banking.{table}" for table in banking.DROP_ORDER])
    assert tables.tables("banking").count() == 0
