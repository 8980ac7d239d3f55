"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulage.llm import periodic_runs
from haulage.llm.periodic_runs import Limits, collapse_runs, runs_of
from haulage.llm.queries import with_planted_runs
from tests.llm.conftest import LONG, ROWS


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def defined(words, limits=Limits()):
    """Every maximal stretch of its smallest period, lag by lag."""
    found, n = [], len(words)
    for q in range(1, n // limits.exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= limits.least(q):
                if not any(p < q and s <= i and s + m >= j + q for s, m, p in found):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rnd):
    words = []
    while rnd.random() < 0.85:
        unit = rnd.choices("abcde", k=rnd.randrange(1, 9))
        words += unit * rnd.choice([1, 1, 3, 4, 5, 9]) + unit[: rnd.randrange(len(unit))]
    return words


def found_in(lists, limits=Limits()):
    _, symbols = np.unique([w for ws in lists for w in ws] or ["-"], return_inverse=True)
    first = np.concatenate([[0], np.cumsum(list(map(len, lists)), dtype=np.int64)])
    return runs_of(symbols[: first[-1]], first, limits)


@pytest.mark.parametrize("limits", [Limits(), Limits(1, 4), Limits(12, 4), Limits(6, 5), Limits(20, 7)])
def test_runs_against_the_definition(limits):
    rnd = random.Random(limits.length * 10 + limits.exponent)
    lists = [random_words(rnd) for _ in range(1500)]
    lists += [rnd.choices("ab", k=rnd.randrange(40)) for _ in range(1500)]
    lists += [["a"] * k for k in range(12)] + [list("ab" * 30 + "aab" * 30 + "ab" * 30)]
    assert found_in(lists, limits) == [defined(ws, limits) for ws in lists]
    assert sum(map(len, found_in(lists, limits))) > 100


def test_long_periods_and_structured_words():
    rnd = random.Random(6)
    unit = rnd.choices("abcdefgh", k=700)
    thue = [bin(k).count("1") % 2 for k in range(1 << 13)]
    square_free = [str((thue[k + 1] - thue[k])) for k in range(len(thue) - 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lists = [unit * 6 + unit[:33], list(map(str, thue[:2500])), square_free[:2500], list(fibonacci[-1][:2000]), ["x"] * 5000]
    found = found_in(lists)
    assert found == [defined(ws) for ws in lists]
    assert found[0] == [(0, 6 * 700 + 33, 700)] and found[4] == [(0, 5000, 1)] and not found[2]
    assert found_in([list(map(str, thue)) * 4]) == [[(0, 4 << 13, 1 << 13)]]


def test_splitting_leaves_what_may_hold_a_run():
    lists = [list("xabcabcabcabcyabc"), list("aaaaab"), list("abcd"), []]
    _, symbols = np.unique([w for ws in lists for w in ws], return_inverse=True)
    first = np.concatenate([[0], np.cumsum(list(map(len, lists)))])
    starts, lengths = periodic_runs.surviving(symbols, first, Limits())
    assert list(zip(starts.tolist(), lengths.tolist(), strict=True)) == [(1, 12)]


def test_one_block_hash_for_all_is_still_exact(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", np.zeros_like)
    rnd = random.Random(9)
    lists = [random_words(rnd) for _ in range(300)]
    assert found_in(lists) == [defined(ws) for ws in lists]


def test_odd_rows_and_the_columns_beside(odd, none, spark):
    again = " ".join(["one two three"] * 8)
    odd = odd.union(odd.where("doc_id = 6").withColumn("text", F.lit(again))).withColumn("periodic", F.lit("mine"))
    df = collapse_runs(odd)
    assert df.columns == odd.columns and df.where("kept <> 'x'").count() == 0
    rows = [*ROWS, (6, again, "en")]
    expected = []
    for key, text, _ in rows:
        words = words_of(text)
        runs = defined(words) if text != LONG else []
        short = collapsed(words, runs)
        expected.append((key, short if runs else text, len(words), runs, hashlib.sha256(short.encode()).hexdigest()))
    found = [
        (r.doc_id, r.text, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed_sha256)
        for r in df.collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert any(r[3] for r in expected) and collapse_runs(none).count() == 0
    same = collapse_runs(odd, with_text=False).select("doc_id", "text").collect()
    assert sorted(map(tuple, same), key=repr) == sorted(((k, t) for k, t, _ in rows), key=repr)


def test_planted_runs_follow_the_contract(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices("abcdefghij", k=rnd.randrange(90)))) for k in range(-40, 400)]
    rows += [(None, "a b c"), (7, None), (28, ""), (31, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = df.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("t"), "text").collect()
    planted = 0
    for key, changed, text in found:
        words = words_of(text)
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p if i >= a else i] for i in range(n)]
            planted += 1
        assert words_of(changed) == words
    assert planted > 20
