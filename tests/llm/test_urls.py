"""Url verdicts against the rules themselves, and cascades small enough to make mistakes."""

import random

import pytest
from pyspark.sql import functions as F

from haulage.llm.url_filter import UrlRule, cascade, judge_urls
from haulage.operators import bloom

RULES = [
    UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"), UrlRule("a.b", "", "block"), UrlRule("b", "/x", "allow"),
]
URLS = [
    None, "", "no scheme", "http://", "://", "http://NET", "http://NET/", "http://net?x=/", "https://Example.NET/en/a?b#c",
    "https://example.net/EN/", "ftp://x.example.net/en/", "http://myexample.net/en/", "http://.net/", "http://net./",
    "http://a://b.net/", "http://example.com/de", "http://example.com/de/", "http://m.example.com/de/x#/de/", "http://org/fr/",
    "http://a.b", "http://c.a.b?q", "http://a.b/x", "http://b/x/y", "http://u@net:80/", "http://ünï.net/é", "x\ny://é.org/fr/\n?z",
    "http://" + "s." * 300 + "net/" + "p" * 5000,
]


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def found(df):
    return sorted((tuple(r) for r in df.select("id", "host", "path", "rule", "verdict").collect()), key=repr)


def table(spark, urls):
    return spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id long, url string")


@pytest.mark.parametrize("bits", [1, 16])
def test_verdicts_against_the_rules(spark, bits):
    rnd = random.Random(4)
    hosts = ["net", "example.net", "example.com", "org", "a.b", "b", "www.b", "c.a.b", "com", "x.org", "example.org"]
    paths = ["", "/", "/en/", "/de/", "/fr/", "/x", "/xy?z", "/en", "?a", "#b", "/fr/#"]
    urls = URLS + [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(400)]
    df = judge_urls(table(spark, urls).repartition(3), RULES, bits_a_key=bits)
    assert found(df) == sorted(((k, *expected(u, RULES)) for k, u in enumerate(urls)), key=repr)


def test_many_rules(spark):
    rules = [UrlRule(f"h{k}.example", "/" if k % 3 else f"/{k}", "block" if k % 2 else "allow") for k in range(500)]
    urls = [f"http://{'s.' * (k % 3)}h{k}.example/{k if k % 7 else ''}" for k in range(1500)]
    df = judge_urls(table(spark, urls), rules)
    assert found(df) == sorted(((k, *expected(u, rules)) for k, u in enumerate(urls)), key=repr)


def test_no_rows_no_rules_other_columns_and_repeated_rows(spark):
    assert judge_urls(table(spark, []), RULES).count() == 0
    none = judge_urls(table(spark, URLS), [], default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    odd = table(spark, [URLS[6]] * 3).selectExpr("1L AS id", "url", "'x' AS host", "'y' AS rule", "'z' AS key", "'k' AS size")
    df = judge_urls(odd, RULES)
    assert df.columns == [*odd.columns, "path", "verdict"]
    assert found(df) == [(1, "net", "/", "net/", "block")] * 3 and df.first()["key"] == "z"


def test_rules_that_are_refused(spark):
    df = table(spark, URLS)
    for rules in ([UrlRule("", "/", "block")], [UrlRule("NET", "/", "block")], [UrlRule("net", "/", "drop")]):
        with pytest.raises(ValueError, match="not a rule"):
            judge_urls(df, rules)
    with pytest.raises(ValueError, match="both"):
        judge_urls(df, [UrlRule("net", "/", "block"), UrlRule("net", "/", "allow")])


@pytest.mark.parametrize("bits", [2, 4, 12])
def test_a_cascade_is_exact_over_its_universe(spark, bits):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 40 = 0").union(spark.createDataFrame([("elsewhere",)], "key string"))
    # The size is said to be small, so that the first level is and the next ones have work.
    held = cascade(listed, universe, 1, bits)
    assert len(held.levels) >= (4 if bits == 2 else 2)
    assert universe.where(held.holds(F.col("key")) != F.expr("xxhash64(key) % 40 = 0")).count() == 0
    sized = cascade(listed, universe, 20_000, 12)
    assert sum(x.size_bytes for x in sized.levels) < 500 * 12 / 8 * 3 * 2


def test_a_list_beyond_a_level_is_refused(spark, monkeypatch):
    monkeypatch.setattr("haulage.llm.url_filter.MOST_WORDS", 4)
    keys = spark.range(100).selectExpr("cast(id AS string) AS key")
    with pytest.raises(ValueError, match="at most"):
        cascade(keys, keys, 100)


def test_a_filter_holds_what_was_put_in(spark):
    keys = spark.range(5000).selectExpr("if(id % 50 = 0, null, cast(id AS string)) AS key")
    held = bloom.build(keys, "key", bloom.words_for(5000), tables=2)
    others = spark.range(5000, 55_000).selectExpr("cast(id AS string) AS key")
    assert keys.where(~held.may_hold(F.col("key"))).where("key is not null").count() == 0
    assert keys.where(held.may_hold(F.col("key"))).where("key is null").count() == 0
    assert others.where(held.may_hold(F.col("key"))).count() < 250
    nothing = bloom.build(keys.limit(0), "key", 1)
    assert keys.where(nothing.may_hold(F.col("key"))).count() == 0
    with pytest.raises(ValueError, match="words"):
        bloom.build(keys, "key", 0)
