"""One row of each key, whatever the keys look like."""

import pytest
from pyspark.sql import functions as F

from haulage.operators import bloom, unique
from haulage.operators.quality import Rule
from haulage.plans.load import load, screened
from haulage.plans.spec import LoadSpec
from haulage.session import fresh_warehouse
from tests.conftest import plan_of, rows


def test_one_row_of_each_key_stays(spark):
    data = [(1, "a"), (1, "b"), (1, "a"), (None, "x"), (None, "x"), (2, "c"), (3, None), (3, None)]
    df = unique.arrived(spark.createDataFrame(data, "k int, v string").repartition(3))
    stay, go = unique.winners(df, ["k"])
    assert rows(stay, "k").count((None,)) == 2 and [r for r in rows(stay, "k") if r[0]] == [(1,), (2,), (3,)]
    assert sorted(rows(stay, "k", "v") + rows(go, "k", "v"), key=repr) == sorted(data, key=repr)
    again = unique.winners(unique.arrived(spark.createDataFrame(data[::-1], "k int, v string").repartition(2)), ["k"])[0]
    assert rows(again, "k", "v") == rows(stay, "k", "v")


def test_a_key_of_a_third_of_all_rows_stays_spread(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id % 5 AS v", "map('a', id % 2) AS m")
    stay, go = unique.winners(unique.arrived(df.repartition(6)), ["k"])
    assert stay.count() == 20_001 and go.count() == 9_999 and go.select("k").distinct().count() == 1
    # What is shuffled for the keys is summed up first, and rows are joined by their own numbers.
    plan = plan_of(stay)
    assert "partial_min" in plan and "Window" not in plan
    shuffled = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert shuffled and all("(_arrived" in line or "(k#" in line or "(_first" in line for line in shuffled)


def test_stored_keys_are_pruned_as_they_are_scanned(spark, tmp_path):
    stored = spark.range(100_000).selectExpr("id AS k", "'s' AS v")
    stored.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    new = unique.arrived(spark.range(99_990, 100_010).selectExpr("id AS k", "'n' AS v"))
    possible = unique.possible(stored, new, ["k"], 20)
    assert {k for k in range(99_990, 100_000)} <= {r[0] for r in possible.collect()} and possible.count() < 500
    fresh, known = unique.against_stored(new, stored, ["k"], 20)
    assert rows(fresh, "k") == [(k,) for k in range(100_000, 100_010)] and known.count() == 10


def test_keys_beyond_a_filter_are_joined_without_one(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_WORDS", 2)
    stored = spark.range(100).selectExpr("id AS k")
    new = unique.arrived(spark.range(50, 150).selectExpr("id AS k"))
    assert unique.possible(stored, new, ["k"], 100).count() == 100
    fresh, known = unique.against_stored(new, stored, ["k"], 100)
    assert fresh.count() == 50 and known.count() == 50


def test_several_keys_rules_and_stored_rows_at_once(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    data = [(1, "z"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (5, "c"), (-1, "d"), (6, None), (None, "e")]
    df = spark.createDataFrame(data, "k int, v string")
    kept, refused = screened(df, [Rule("k is positive", F.col("k") > 0)], [["k"], ["v"]], stored)
    found = rows(kept)
    assert [r for r in found if r[1] != "b"] == [(None, "e"), (5, "c"), (6, None)] and sum(r[1] == "b" for r in found) == 1
    reasons = {(r.k, r.v): r.broken_rules for r in refused.collect()}
    assert reasons[1, "z"] == ["k is unique"] and reasons[2, "a"] == ["v is unique"] and reasons[-1, "d"] == ["k is positive"]
    assert reasons[5, "c"] == ["k is unique"] and refused.count() == 5


def test_whole_rows_are_marked_once_for_both_results(spark):
    stored = spark.range(0, 60, 3).selectExpr("id AS k", "'s' AS v")
    new = spark.range(200).selectExpr("if(id % 50 = 7, NULL, id % 80) AS k", "cast(id AS string) AS v").repartition(5)
    kept, refused = screened(new, [], [["k"], ["v"]], stored)
    for part in (kept, refused):
        plan = plan_of(part)
        assert "Exchange" not in plan and "Join" not in plan
    first = sorted(k for (k,) in rows(kept, "k") if k is not None)
    assert first == [k for k in range(80) if k >= 60 or k % 3] and kept.where("k is null").count() == 4
    assert sorted(rows(kept, "v") + rows(refused, "v")) == sorted(rows(new, "v"))
    assert {tuple(r) for (r,) in rows(refused, "broken_rules")} == {("k is unique",)}


@pytest.mark.parametrize("empty", ["new", "stored"])
def test_an_empty_side(spark, tables, empty):
    path = f"{fresh_warehouse(spark)}/rows"
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    (df.limit(0) if empty == "new" else df).write.parquet(path)
    tables.write(df.limit(0) if empty == "stored" else df, "default.rows", "append")
    load(spark, LoadSpec("rows", path=path, mode="append"), tables, unique=[["k"]])
    assert tables.read("default.rows").count() == (2 if empty == "new" else 1)
    assert tables.read("default.rows_rejected").count() == (0 if empty == "new" else 1)


def test_a_stored_key_of_a_wider_type(spark):
    stored = spark.createDataFrame([(1,), (2**40,), (None,)], "k bigint")
    new = unique.arrived(spark.createDataFrame([(1,), (2,)], "k int"))
    fresh, known = unique.against_stored(new, stored, ["k"], 2)
    assert rows(fresh, "k") == [(2,)] and rows(known, "k") == [(1,)]
    halves = spark.createDataFrame([(1.5,), (2.0,)], "k double")
    fresh, known = unique.against_stored(new, halves, ["k"], 2)
    assert rows(fresh, "k") == [(1,)] and rows(known, "k") == [(2,)]
