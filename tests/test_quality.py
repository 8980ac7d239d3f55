import hashlib
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haulage.functions import derive
from haulage.operators import profile, quality
from haulage.operators.quality import Rule
from tests.conftest import plan_of, rows


@pytest.fixture
def people(spark):
    data = [
        (1, "a@x.org", "123-45-6789", 10.0, "open", None),
        (2, "nobody", "123456789", -1.0, "closed", None),
        (3, None, None, None, None, None),
        (4, "b@x.org", "123-45-678", 0.0, "closed", "2024-01-01"),
    ]
    return spark.createDataFrame(
        data, "id int, email string, ssn string, balance double, status string, closed_at string"
    )


@pytest.fixture
def rules(spark):
    return [
        Rule("email", quality.has_text(F.col("email"), "@")),
        Rule("ssn", quality.text_length(F.col("ssn"), 11, 11) & (quality.occurrences(F.col("ssn"), "-") == 2)),
        Rule("balance", quality.not_negative(F.col("balance"))),
        Rule("closing", quality.exactly_when(F.col("status") == "closed", F.col("closed_at").isNotNull())),
    ]


def test_null_passes_and_false_is_named(people, rules):
    found = dict(rows(quality.judged(people, rules), "id", "broken_rules"))
    assert found == {1: [], 2: ["email", "ssn", "balance", "closing"], 3: [], 4: ["ssn"]}


def test_split_loses_no_row(people, rules):
    accepted, rejected = quality.split(people, rules)
    assert accepted.columns == people.columns
    assert [r[0] for r in rows(accepted, "id")] == [1, 3]
    assert [r[0] for r in rows(rejected, "id")] == [2, 4]


def test_summary_is_one_scan_and_one_small_shuffle(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    report = quality.summary(
        orders,
        [
            Rule("status", quality.in_set(F.col("o_orderstatus"), ["F", "O"])),
            Rule("price", quality.positive(F.col("o_totalprice"))),
        ],
    )
    plan = plan_of(report)
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan


def test_summary_counts(people, rules):
    assert rows(quality.summary(people, rules)) == [
        ("balance", 4, 1), ("closing", 4, 1), ("email", 4, 1), ("ssn", 4, 2),
    ]


def test_conditions(spark):
    df = spark.sql("SELECT date'2000-06-15' AS born, date'2024-06-14' AS today, 5 AS n")
    checks = df.select(
        quality.age_in_years(F.col("born"), F.col("today")),
        quality.within_days(F.col("born"), F.col("today"), 30),
        quality.in_range(F.col("n"), 5, 5),
        quality.implies(F.col("n") > 9, F.col("n") < 0),
        quality.implies(F.col("n") > 1, F.col("n") < 0),
    )
    assert tuple(checks.first()) == (23, False, True, True, False)


def test_unique_ignores_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c")], "k int, v string"
    )
    assert rows(quality.repeated_keys(df, ["k", "v"])) == [(1, "a", 3)]
    assert rows(quality.unique_summary(df, ["k"])) == [(1, 2)]
    assert rows(quality.unique_summary(df.limit(0), ["k"])) == [(0, 0)]


def test_null_counts(people):
    assert rows(quality.null_counts(people, ["id", "email"])) == [("email", 4, 1), ("id", 4, 0)]


# --- derivations --------------------------------------------------------------


def test_money_ties_go_to_the_even_cent(spark):
    df = spark.createDataFrame([("0.125",), ("0.135",), ("-0.125",), ("2.675",)], "v string")
    found = [r[0] for r in df.select(derive.money(F.col("v").cast("decimal(10,3)"))).collect()]
    assert found == [Decimal("0.12"), Decimal("0.14"), Decimal("-0.12"), Decimal("2.68")]


def test_instalment_and_maturity(spark):
    df = spark.sql("SELECT 1000BD AS p, 36 AS n, date'2024-01-31' AS d")
    paid = df.select(derive.instalment(F.col("p"), F.col("n")), derive.maturity(F.col("d"), F.col("n")))
    assert str(paid.first()[0]) == "31.94" and str(paid.first()[1]) == "2027-01-15"


def test_instalment_tie(spark):
    # 1.15 * p / n with p = 0.30, n = 6 is 0.0575; with p = 0.10, n = 23 it is 0.005.
    df = spark.sql("SELECT 0.10BD AS p, 23 AS n UNION ALL SELECT 0.30BD, 23")
    found = [str(r[0]) for r in df.select(derive.instalment(F.col("p"), F.col("n"))).collect()]
    assert found == ["0.00", "0.02"]


def test_instalments_round_exactly(spark):
    random.seed(11)
    cases = [(random.randint(1, 10**9), random.choice([24, 36, 60, 120, 360])) for _ in range(3000)]
    cases += [(cents, 24) for cents in range(1, 500)]
    df = spark.createDataFrame(
        [(Decimal(cents) / 100, months) for cents, months in cases], "p decimal(15,2), n int"
    )
    found = [r[0] for r in df.select(derive.instalment(F.col("p"), F.col("n"))).collect()]
    # Python rounds a fraction to the nearest whole number, ties to even.
    assert found == [Decimal(round(Fraction(c * 115, 100 * n))) / 100 for c, n in cases]


def test_text_derivations(spark):
    df = spark.sql("SELECT 'Smith, Jones and Co' AS n, 'deposit' AS k, 'Salary' AS c, cast(null as int) AS z")
    found = df.select(
        derive.site_url(F.col("n")),
        derive.labelled(F.col("k"), F.col("c")),
        derive.truncated(F.col("n"), 5),
        derive.json_object(field=F.col("c"), empty=F.col("z")),
        derive.only_when(F.col("k") == "fee", F.col("c")),
    ).first()
    assert tuple(found) == (
        "https://smithjonesandco.example.com", "Deposit: Salary", "Smith",
        '{"field":"Salary","empty":null}', None,
    )


# --- profile ------------------------------------------------------------------


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    first = rows(profile.sample_keys(df, "k", 0.4, seed=7))
    again = rows(profile.sample_keys(df.repartition(7), "k", 0.4, seed=7))
    assert len(first) == len(set(first)) == 2000 and first == again
    assert rows(profile.sample_keys(df, "k", 0.4, seed=8)) != first
    assert profile.sample_keys(df, "k", 0.00001, seed=7).count() == 1
    assert profile.sample_keys(df, "k", 1.0, seed=7).count() == 5000
    assert profile.sample_keys(df.limit(0), "k", 0.5, seed=7).count() == 0


def test_sample_is_the_smallest_hashes(spark):
    import hashlib

    df = spark.range(3000).withColumnRenamed("id", "k")
    wanted = sorted(range(3000), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())[:1200]
    assert [r[0] for r in rows(profile.sample_keys(df, "k", 0.4, seed=7))] == sorted(wanted)


def test_lookups_reach_the_scan(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    plan = plan_of(profile.where_equal(events, event_type="view").select("event_id"))
    assert "EqualTo(event_type,view)" in plan
    plan = plan_of(profile.in_period(events, "ts", "2024-01-02", "2024-01-03"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_json_contains_an_object(spark):
    texts = [
        '{"a": 1, "b": {"c": "x", "d": true}}', '{"a": 1.0, "b": {"c": "x"}}', '{"b": 2}', "[1]",
        "no json", None, '{"a": [2, 1]}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def found(wanted):
        return [r[0] for r in df.select(profile.json_holds(F.col("t"), wanted)).collect()]

    assert found({"a": 1}) == [True, True] + [False] * 5
    assert found({"a": 1, "b": {"c": "x", "d": True}}) == [True] + [False] * 6
    assert found({"b": 2}) == [False, False, True] + [False] * 4
    assert found({"a": [1]}) == [False] * 6 + [True]
    assert found({"a": [1, 3]}) == [False] * 7
    with pytest.raises(TypeError, match="cannot look for"):
        profile.json_holds(F.col("t"), {"a": object()})


def test_column_stats_of_nested_columns(spark):
    df = spark.createDataFrame([([1], 2), (None, 3)], "a array<int>, b int")
    assert rows(profile.column_stats(df)) == [("a", 2, 1, None, None), ("b", 2, 0, "2", "3")]


def test_children_per_parent_without_parents(spark):
    df = spark.range(3)
    assert rows(profile.children_per_parent(df.limit(0), df)) == [(0, 3, None)]


def test_refresh_statistics(spark, tmp_path):
    spark.range(10).write.option("path", str(tmp_path / "t")).saveAsTable("counted")
    try:
        profile.refresh_statistics(spark, "counted")
        described = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED counted").collect()}
        assert "10 rows" in described["Statistics"]
    finally:
        spark.sql("DROP TABLE counted")


@pytest.mark.parametrize("few", [1, 3, 1 << 16])
@pytest.mark.parametrize("ratio", [0.0, 0.001, 0.37, 1.0])
def test_a_sample_is_the_smallest_hashes(spark, monkeypatch, few, ratio):
    monkeypatch.setattr(profile, "FEW", few)
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    found = sorted(r[0] for r in profile.sample_keys(df, "k", ratio, 5).collect())
    order = sorted(keys, key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    assert found == sorted(order[: max(1, int(3000 * ratio))])


def test_a_sample_shuffles_no_keys(spark, data):
    customers = spark.read.parquet(f"{data}/customer.parquet")
    assert "Exchange" not in plan_of(profile.sample_keys(customers, "c_custkey", 0.4, 1))
    assert profile.sample_keys(customers.limit(0), "c_custkey", 0.4, 1).count() == 0
    some = spark.createDataFrame([(None,), (7,)], "k int")
    assert rows(profile.sample_keys(some, "k", 0.5, 1)) == [(None,)] and profile.sample_keys(some, "k", 1.0, 1).count() == 2
