"""Names within an edit distance, against all pairs."""

import random

import pytest

from haulage.operators.names import close_names, closest_name
from tests.conftest import rows


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def misspelt(rnd, text):
    letters = list(text)
    for _ in range(rnd.randrange(4)):
        at = rnd.randrange(len(letters) + 1)
        what = rnd.randrange(3)
        if what == 0:
            letters.insert(at, rnd.choice("abé "))
        elif letters and at < len(letters):
            letters[at : at + 1] = [] if what == 1 else [rnd.choice("abc")]
    return "".join(letters)


@pytest.mark.parametrize("most, q", [(0, 2), (1, 1), (1, 3), (2, 2), (3, 2)])
def test_all_close_pairs_are_found(spark, most, q):
    rnd = random.Random(most * 10 + q)
    known = ["".join(rnd.choices("abcd", k=rnd.randrange(12))) for _ in range(60)] + ["", "a", "aaaaaaaa"]
    known += ["".join(rnd.choices("abcdefghijklmnop ", k=20)) for _ in range(20)]
    written = [misspelt(rnd, rnd.choice(known)) for _ in range(120)] + [None, "", "a", "zzzz"]
    left = spark.createDataFrame([(k, t) for k, t in enumerate(written)], "id int, name string").repartition(3)
    right = spark.createDataFrame([(t,) for t in known] + [(None,)], "known string")
    expected = sorted(
        (a, b, distance(a, b)) for a in set(written) - {None} for b in set(known) if distance(a, b) <= most
    )
    assert rows(close_names(left, "name", right, "known", most, q)) == expected
    best = {a: min((d, b) for x, b, d in expected if x == a) for a, _, _ in expected}
    found = closest_name(left, "name", right, "known", most, q).collect()
    assert sorted((r.id, r.matched, r.distance) for r in found) == [
        (k, *(best[t][::-1] if t in best else (None, None))) for k, t in enumerate(written)
    ]


def test_a_frequent_name_is_worked_through_once(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'acme corp', concat('firm ', id)) AS name")
    right = spark.createDataFrame([("acme corp.",), ("firm 7",)], "known string")
    pairs = close_names(left, "name", right, "known", 1)
    assert ("acme corp", "acme corp.", 1) in rows(pairs) and pairs.where("name = 'acme corp'").count() == 1
    assert closest_name(left, "name", right, "known", 1).where("matched = 'acme corp.'").count() == 1000
    assert close_names(left.limit(0), "name", right, "known").count() == 0
    assert closest_name(left, "name", right.limit(0), "known").where("matched is not null").count() == 0
    with pytest.raises(ValueError, match="already"):
        closest_name(left.withColumnRenamed("id", "distance"), "name", right, "known")
    with pytest.raises(ValueError, match="0 or more"):
        close_names(left, "name", right, "known", -1)
