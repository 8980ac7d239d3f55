import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from haulage.operators import running, skew
from haulage.plans.load import append_movements
from haulage.session import checkpointed
from tests.conftest import rows

CREDITS = ["deposit", "interest"]
DEBITS = ["withdrawal", "transfer", "payment", "fee"]


def fold(opening, moves):
    balance, found = Decimal(opening), []
    for kind, amount in moves:
        balance += amount if kind in CREDITS else -amount
        balance = max(balance, Decimal(0))
        found.append(balance)
    return found


def replay(df, **how):
    return running.ledger(
        df, account="user_id", order=["id"], kind="kind", amount="amount",
        credits=CREDITS, debits=DEBITS, opening=F.col("opening"), **how,
    )


def test_ledger_reaches_the_floor_and_recovers(spark):
    moves = [("fee", 30), ("payment", 100), ("deposit", 50), ("transfer", 20)]
    data = [(i, 1, k, Decimal(a), Decimal(100)) for i, (k, a) in enumerate(moves)]
    df = spark.createDataFrame(
        data, "id int, user_id int, kind string, amount decimal(15,2), opening decimal(15,2)"
    )
    found = [row.balance_after for row in replay(df).orderBy("id").collect()]
    assert found == [Decimal(70), Decimal(0), Decimal(50), Decimal(30)]


@pytest.fixture(scope="module")
def movements(spark):
    random.seed(3)
    kinds = ["deposit", "withdrawal", "transfer", "payment", "fee", "interest"]
    data, expected = [], {}
    for user in [None, *range(12)]:
        opening = random.choice([0, 100, 500])
        n = 700 if user in (3, None) else random.randint(0, 40)
        moves = [(random.choice(kinds), Decimal(random.randint(1, 30000)) / 100) for _ in range(n)]
        ids = sorted(random.sample(range(100_000), n))
        for i, (kind, amount), after in zip(ids, moves, fold(opening, moves)):
            data.append((i, user, kind, amount, Decimal(opening)))
            expected[(user, i)] = after
    random.shuffle(data)
    df = spark.createDataFrame(
        data, "id int, user_id int, kind string, amount decimal(15,2), opening decimal(15,2)"
    )
    return df.repartition(5), expected


@pytest.mark.parametrize(
    "how",
    [{}, {"parts": 1}, {"parts": 7}, {"parts": 500}],
)
def test_ledger_equals_a_fold(movements, how):
    df, expected = movements
    found = {(r.user_id, r.id): r.balance_after for r in replay(df, **how).collect()}
    assert found == expected


def test_opening_balances_from_a_table(movements):
    df, expected = movements
    accounts = df.select("user_id", "opening").distinct().withColumnRenamed("user_id", "key")
    accounts = accounts.where("key IS NOT NULL")
    found = running.ledger(
        df.drop("opening"), account="user_id", order=["id"], kind="kind", amount="amount",
        credits=CREDITS, debits=DEBITS, opening=running.Opening(accounts, "key", "opening"), parts=5,
    ).collect()
    assert len(found) == len(expected)
    known = {(r.user_id, r.id): r.balance_after for r in found if r.user_id is not None}
    assert known == {k: v for k, v in expected.items() if k[0] is not None}


def states(rules, opening, df, cuts):
    """Balances and the last state, load by load."""
    found, state = {}, None
    for low, high in zip([0, *cuts], [*cuts, 10**9]):
        balances, state = rules.replay(df.where(f"id >= {low} and id < {high}"), opening, state, parts=5)
        state = checkpointed(state)
        found |= {(r.user_id, r.id): (r.position, r.balance_after) for r in balances.collect()}
    return found, {r.user_id: (r["count"], r["total"], r["lowest"], r["last"][0]) for r in state.collect()}


@pytest.mark.parametrize("cuts", [(50_000,), (10, 30_000, 30_001, 90_000)])
@pytest.mark.parametrize("table", [True, False])
def test_loads_carry_on_from_states(movements, cuts, table):
    df, expected = movements
    rules = running.Movements("user_id", ("id",), "kind", "amount", tuple(CREDITS), tuple(DEBITS))
    accounts = df.select("user_id", "opening").distinct().where("user_id IS NOT NULL")
    opening = running.Opening(accounts, "user_id", "opening") if table else F.col("opening")
    rows_of = df.where("user_id IS NOT NULL") if table else df
    found, behind = states(rules, opening, rows_of, cuts)
    whole, at_once = states(rules, opening, rows_of, ())
    assert found == whole and behind == at_once
    assert {k: v[1] for k, v in found.items()} == {k: v for k, v in expected.items() if k in found}
    assert len(found) == rows_of.count() and set(behind) == {k for k, _ in found}


def test_a_movement_that_comes_late_fails(spark, movements):
    df, _ = movements
    rules = running.Movements("user_id", ("id",), "kind", "amount", tuple(CREDITS), tuple(DEBITS))
    state = checkpointed(rules.replay(df, F.col("opening"))[1])
    for shift in (0, -1):
        late = df.where("user_id = 3").orderBy(F.desc("id")).limit(1).withColumn("id", F.col("id") + shift)
        with pytest.raises(Exception, match="comes before one"):
            rules.replay(late, F.col("opening"), state)[0].collect()
    new = df.where("user_id = 3").limit(1).withColumns({"id": F.lit(200_000), "user_id": F.lit(77)})
    assert rules.replay(new, F.col("opening"), state)[1].count() == state.count() + 1


def test_a_load_that_died_between_state_and_rows_is_no_start(movements, tables):
    df, expected = movements
    rules = running.Movements("user_id", ("id",), "kind", "amount", tuple(CREDITS), tuple(DEBITS))
    append_movements(tables, "bank.moves", df.where("id < 40000"), rules, F.col("opening"))
    tables.write(tables.read("bank.moves_state").where("false"), "bank.moves_state", "overwrite")
    append_movements(tables, "bank.moves", df.where("id >= 40000"), rules, F.col("opening"))
    assert {(r.user_id, r.id): r.balance_after for r in tables.read("bank.moves").collect()} == expected


def test_running_count_of_any_cut(movements):
    df, _ = movements
    whole = rows(running.running_count(df, "user_id", ["id"], parts=1), "user_id", "id", "running_count")
    cut = rows(running.running_count(df, "user_id", ["id"], parts=6), "user_id", "id", "running_count")
    assert whole == cut
    assert max(n for _, _, n in whole) == 700


def test_a_key_is_never_one_window_group(movements):
    df, _ = movements
    sizes = [r["count"] for r in running.ranged(df, ["user_id", "id"], 16).groupBy("_part").count().collect()]
    assert len(sizes) > 8 and sum(sizes) == df.count() and max(sizes) < 700 / 2


def test_stretches_are_handed_forward_over_many(spark):
    data = [(k, "a" if k < 300 else "b", Decimal(k % 7 - 3)) for k in range(600)] + [(0, None, Decimal(1))]
    df = spark.createDataFrame(data, "id int, k string, amount decimal(15,2)").repartition(3)
    found = {(r.k, r.id): (r._count, r._total, r._low) for r in running.running_values(df, "k", ["id"], F.col("amount"), parts=40).collect()}
    for key in ("a", "b", None):
        total, low, n = Decimal(0), None, 0
        for k, own, amount in sorted((d for d in data if d[1] == key)):
            total, n = total + amount, n + 1
            low = total if low is None else min(low, total)
            assert found[own, k] == (n, total, low)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_null_amount_moves_nothing(spark, parts):
    data = [(i, 1, "deposit", None if i % 3 == 0 else Decimal(i)) for i in range(30)]
    df = spark.createDataFrame(data, "id int, user_id int, kind string, amount decimal(15,2)")
    df = df.withColumn("opening", F.lit(10))
    found = [r.balance_after for r in replay(df, parts=parts).orderBy("id").collect()]
    total, expected = 10, []
    for i in range(30):
        total += i if i % 3 else 0
        expected.append(Decimal(total))
    assert found == expected


@pytest.mark.parametrize("kind", ["refund", None])
def test_a_kind_in_neither_list_fails(spark, kind):
    df = spark.createDataFrame(
        [(1, 1, kind, Decimal(5), Decimal(0))],
        "id int, user_id int, kind string, amount decimal(15,2), opening decimal(15,2)",
    )
    with pytest.raises(Exception, match="neither a credit nor a debit"):
        replay(df).collect()
    with pytest.raises(ValueError, match="both credits and debits"):
        running.ledger(
            df, account="user_id", order=["id"], kind="kind", amount="amount",
            credits=["fee"], debits=["fee"], opening=F.lit(0),
        )


def test_mismatches_allow_a_cent_per_step(movements):
    df, _ = movements
    replayed = replay(df)
    exact = replayed.withColumn("stored", F.col("balance_after"))
    assert running.ledger_mismatches(exact, "stored").count() == 0
    drifting = replayed.withColumn(
        "stored", F.col("balance_after") + F.col("position") * F.lit("0.01").cast("decimal(3,2)")
    )
    assert running.ledger_mismatches(drifting, "stored").count() == 0
    wrong = replayed.withColumn("stored", F.col("balance_after") + F.col("position") + 1)
    assert running.ledger_mismatches(wrong, "stored").count() == df.count()
    lost = replayed.withColumn("stored", F.lit(None).cast("decimal(15,2)"))
    assert running.ledger_mismatches(lost, "stored").count() == df.count()


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [(1, 5), (1, 3), (2, 9), (None, 4), (None, 2)], "user_id int, id int"
    )
    flagged = rows(running.flag_first(df, ["user_id"], "id"))
    assert flagged == [(None, 2, True), (None, 4, False), (1, 3, True), (1, 5, False), (2, 9, True)]


def test_turned_away_keeps_the_first_and_all_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 1, 3), ("a", 2, 9), (None, 1, 4), (None, 1, 2), ("a", 1, 8)],
        "k string, j int, id int",
    )
    assert rows(running.turned_away(df, ["k", "j"], "id")) == [("a", 1, 5), ("a", 1, 8)]
    assert rows(running.turned_away(df, ["k"], "id"), "id") == [(5,), (8,), (9,)]


@pytest.fixture(scope="module")
def timeline(spark):
    """A third of the rows share one timestamp, some have none."""
    random.seed(5)
    base = dt.datetime(1969, 12, 31, 23, 59, 0)
    data = []
    for i in range(900):
        if i % 3 == 0:
            ts = base + dt.timedelta(seconds=61)
        elif i % 50 == 1:
            ts = None
        else:
            ts = base + dt.timedelta(milliseconds=random.randint(0, 10**7))
        data.append((i, ts))
    random.shuffle(data)
    return spark.createDataFrame(data, "id int, ts timestamp_ntz").repartition(4)


@pytest.mark.parametrize("parts", [1, 2, 8, 64])
def test_numbers_are_gapless_and_in_order(timeline, parts):
    numbered = running.number_rows(timeline, ["ts", "id"], "n", start=100, parts=parts)
    found = sorted((r.n, r.ts, r.id) for r in numbered.collect())
    order = sorted(found, key=lambda r: (r[1] is not None, r[1], r[2]))
    assert found == order and [n for n, _, _ in found] == list(range(100, 1000))


def test_a_frequent_value_is_cut_by_the_next_column(timeline):
    cut = running.ranged(timeline, ["ts", "id"], 16)
    sizes = [row["count"] for row in cut.groupBy("_part").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 3 * 900 / 16 + 10


def test_many_rows_without_an_order_value_are_cut_too(timeline):
    hollow = timeline.withColumn("ts", F.when(F.col("id") % 2 == 0, F.col("ts")))
    cut = running.ranged(hollow, ["ts", "id"], 16)
    assert max(row["count"] for row in cut.groupBy("_part").count().collect()) < 250
    numbered = running.number_rows(hollow, ["ts", "id"], "n", parts=16).orderBy("n").collect()
    keys = [(r.ts is not None, r.ts, r.id) for r in numbered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("kind", ["string", "binary", "boolean", "bigint", "decimal(30,3)", "date", "timestamp"])
@pytest.mark.parametrize("parts", [1, 8])
def test_any_sortable_type_is_cut_in_order(spark, kind, parts):
    values = {
        "string": ["", "a", "a\0", "prefix-shared-by-many-1", "prefix-shared-by-many-2", "é", "zz", None],
        "binary": [b"", b"\0", b"\0\0", b"abcdefgh", b"abcdefgi", b"\xff", None],
        "boolean": [True, False, None],
        "bigint": [2**60 + 1, 2**60 + 2, 2**60 + 3, -(2**60), -1, 0, 1, None],
        "decimal(30,3)": [Decimal(10) ** 20 + Decimal("0.001") * k for k in range(4)] + [None, Decimal(-1)],
        "date": [dt.date(1969, 1, 1), dt.date(2024, 2, 29), None],
        "timestamp": [dt.datetime(1969, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 2, 29), None],
    }[kind]
    data = [(values[i % len(values)], i) for i in range(200)]
    df = spark.createDataFrame(data, f"v {kind}, id int").repartition(3)
    numbered = running.number_rows(df, ["v", "id"], "n", parts=parts)
    found = [(r.v, r.id) for r in numbered.orderBy("n").collect()]
    assert found == [(r.v, r.id) for r in df.orderBy("v", "id").collect()]
    if parts > 1 and kind != "boolean":
        sizes = running.ranged(df, ["v", "id"], parts).groupBy("_part").count().collect()
        assert max(r["count"] for r in sizes) < 120


def test_rows_with_maps_inside_scatter(spark):
    df = spark.sql("SELECT array(map('a', id)) AS v, struct(map(id, 1) AS m) AS w FROM range(20)")
    assert df.select(skew.spread(df).alias("s")).distinct().count() == 20


def test_parts_of_an_empty_or_constant_table(spark):
    empty = spark.createDataFrame([], "k bigint")
    assert running.number_rows(empty, ["k"], parts=4).count() == 0
    one = spark.createDataFrame([(7,)], "k bigint")
    assert rows(running.number_rows(one, ["k"], parts=4)) == [(7, 1)]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-1.0,)], "k double")
    numbered = running.number_rows(odd, ["k"], "n", parts=4)
    assert [str(r.k) for r in numbered.orderBy("n").collect()] == ["None", "-1.0", "inf", "nan"]
