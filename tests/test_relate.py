import random

import pytest
from pyspark.sql import functions as F

from haulage.operators import relate
from haulage.operators.relate import ForeignKey
from tests.conftest import rows

@pytest.fixture
def parent(spark):
    return spark.createDataFrame([(k, f"p{k}") for k in (1, 2, 3, 7, 8)], "pk bigint, name string")


@pytest.fixture
def child(spark):
    data = [(i, 7) for i in range(30)] + [(100, 1), (101, 2), (102, 55), (103, None), (104, None)]
    return spark.createDataFrame(data, "id int, fk int")


def test_existence(parent, child):
    found = relate.with_parent(child, "fk", parent, "pk")
    assert len(rows(found)) == 32
    assert rows(relate.orphans(child, "fk", parent, "pk")) == [(102, 55)]
    kept = rows(relate.without_parent(child, "fk", parent, "pk"))
    assert [r[0] for r in kept] == [102, 103, 104]


def test_look_up_keeps_every_child(parent, child):
    found = rows(relate.look_up(child, "fk", parent, "pk"), "id", "name")
    assert len(found) == 35
    assert dict(found)[102] is None and dict(found)[103] is None and dict(found)[5] == "p7"


def test_children_of_keeps_every_parent(parent, child):
    found = rows(relate.children_of(parent, "pk", child, "fk"), "pk", "name", "id")
    assert sorted({pk for pk, _, _ in found}) == [1, 2, 3, 7, 8]
    assert len(found) == 30 + 1 + 1 + 2
    assert [i for pk, _, i in found if pk in (3, 8)] == [None, None]


def test_reference_with_repeated_names(spark, child):
    names = spark.createDataFrame([(7, "a"), (7, "b")], "pk int, name string")
    found = rows(relate.look_up(child, "fk", names, "pk"), "id", "name")
    assert len(found) == 30 * 2 + 5


def test_keys_of_the_same_name_appear_once(parent, child):
    parent, child = parent.withColumnRenamed("pk", "k"), child.withColumnRenamed("fk", "k")
    found = relate.children_of(parent, "k", child, "k")
    assert found.columns == ["k", "name", "id"] and found.where("k IS NULL").count() == 0
    found = relate.look_up(child, "k", parent, "k")
    assert found.columns == ["id", "k", "name"] and found.count() == 35
    with pytest.raises(ValueError, match="both sides have columns"):
        relate.look_up(child, "k", parent.withColumnRenamed("name", "id"), "k")


def test_names_that_repeat_in_the_reference(spark, child):
    names = spark.createDataFrame(
        [(1, f"one{i}") for i in range(40)] + [(2, "two"), (2, "zwei"), (7, "seven")],
        "pk int, name string",
    )
    found = relate.look_up(child, "fk", names, "pk")
    assert found.count() == 30 + 40 + 2 + 3


def test_orphan_summary(parent, child):
    assert rows(relate.orphan_summary(child, "fk", parent, "pk")) == [(55, 1)]


def test_set_null_keeps_rows(parent, child):
    deleted = parent.where("pk = 7")
    found = rows(relate.null_deleted(child, "fk", deleted, "pk"))
    assert len(found) == 35 and sum(fk is None for _, fk in found) == 32
    assert relate.null_deleted(child, "fk", deleted, "pk").schema == child.schema


def test_delete_follows_chains_and_mixed_actions(spark):
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id int"),
        "accounts": spark.createDataFrame([(10, 1), (20, 2)], "account_id int, user_id int"),
        "loans": spark.createDataFrame(
            [(100, 1, 10), (200, 2, 10), (300, 2, 20), (400, 2, None)],
            "loan_id int, user_id int, account_id int",
        ),
        "audit": spark.createDataFrame([(1000, 1), (2000, None)], "audit_id int, user_id int"),
    }
    keys = [
        ForeignKey("loans", "account_id", "accounts", "account_id", "set null"),
        ForeignKey("loans", "user_id", "users", "user_id"),
        ForeignKey("accounts", "user_id", "users", "user_id"),
        ForeignKey("audit", "user_id", "users", "user_id", "set null"),
    ]
    after = relate.delete_rows(tables, keys, "users", F.col("user_id") == 1)
    assert rows(after["users"]) == [(2,)]
    assert rows(after["accounts"]) == [(20, 2)]
    assert rows(after["loans"]) == [(200, 2, None), (300, 2, 20), (400, 2, None)]
    assert rows(after["audit"]) == [(1000, None), (2000, None)]
    untouched = relate.delete_rows(tables, keys, "accounts", F.col("account_id") == 10)
    assert rows(untouched["users"]) == [(1,), (2,)]
    assert rows(untouched["loans"])[0] == (100, 1, None)


def test_delete_follows_a_table_that_refers_to_itself(spark):
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "id int, boss int")
    logs = spark.createDataFrame([(10, 4), (11, 5)], "log int, id int")
    keys = [ForeignKey("staff", "boss", "staff", "id"), ForeignKey("logs", "id", "staff", "id")]
    after = relate.delete_rows({"staff": staff, "logs": logs}, keys, "staff", F.col("id") == 1)
    assert rows(after["staff"]) == [(5, None)] and rows(after["logs"]) == [(11, 5)]
    keys = [ForeignKey("staff", "boss", "staff", "id", "set null")]
    after = relate.delete_rows({"staff": staff}, keys, "staff", F.col("id") == 2)
    assert rows(after["staff"]) == [(1, None), (3, None), (4, 3), (5, None)]


def brute_delete(tables, keys, table, condition):
    """Rows as dicts, by following every reference until nothing changes."""
    gone = {name: [name == table and condition(r) for r in held] for name, held in tables.items()}
    changed = True
    while changed:
        changed = False
        for fk in (fk for fk in keys if fk.on_delete == "cascade"):
            lost = {r[fk.parent_key] for r, g in zip(tables[fk.parent], gone[fk.parent]) if g} - {None}
            for k, r in enumerate(tables[fk.child]):
                if r[fk.child_key] in lost and not gone[fk.child][k]:
                    gone[fk.child][k] = changed = True
    after = {}
    for name, held in tables.items():
        kept = [dict(r) for r, g in zip(held, gone[name]) if not g]
        for fk in (fk for fk in keys if fk.child == name and fk.on_delete != "cascade"):
            lost = {r[fk.parent_key] for r, g in zip(tables[fk.parent], gone[fk.parent]) if g} - {None}
            for r in kept:
                r[fk.child_key] = None if r[fk.child_key] in lost else r[fk.child_key]
        after[name] = sorted((tuple(r.values()) for r in kept), key=lambda t: [(v is not None, v) for v in t])
    return after


@pytest.mark.parametrize("pieces", [1, 8])
def test_delete_through_rings_of_tables(spark, monkeypatch, pieces):
    monkeypatch.setattr(relate, "MOST_PIECES", pieces)
    rnd = random.Random(8)
    ref = lambda n: rnd.choice([None, *range(n)])
    tables = {
        "a": [{"id": k, "code": 100 + k, "b": ref(40), "own": k - 1 if k % 9 else None} for k in range(30)],
        "b": [{"id": k, "c": ref(25)} for k in range(40)],
        "c": [{"id": k, "a": 100 + rnd.randrange(60), "d": ref(10)} for k in range(25)],
        "d": [{"id": k} for k in range(10)],
        "e": [{"id": k, "a": ref(30), "c": ref(25)} for k in range(50)],
    }
    keys = [
        ForeignKey("a", "b", "b", "id"), ForeignKey("b", "c", "c", "id"), ForeignKey("c", "a", "a", "code"),
        ForeignKey("a", "own", "a", "id"), ForeignKey("c", "d", "d", "id"), ForeignKey("e", "a", "a", "id", "set null"),
        ForeignKey("e", "c", "c", "id"),
    ]
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in t], ", ".join(f"{k} int" for k in t[0])) for n, t in tables.items()}
    for start, least in (("d", 8), ("a", 28), ("b", 39), ("e", 40)):
        after = relate.delete_rows(frames, keys, start, F.col("id") >= least)
        expected = brute_delete(tables, keys, start, lambda r: r["id"] >= least)
        assert {name: rows(df) for name, df in after.items()} == expected


def test_rings_come_parents_first():
    keys = [ForeignKey("b", "x", "a", "x"), ForeignKey("c", "x", "b", "x"), ForeignKey("b", "y", "c", "y"), ForeignKey("d", "x", "c", "x")]
    assert relate.rings("abcd", keys) == [["a"], ["b", "c"], ["d"]]


def test_unknown_action():
    with pytest.raises(ValueError, match="unknown action"):
        ForeignKey("a", "b", "c", "d", "restrict")
