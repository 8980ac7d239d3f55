"""Verdicts on urls from lists of hosts and paths, held as Bloom filter cascades.

The first level of a cascade holds the listed keys. What it lets through by mistake among all keys that
the urls ask for is held by the second level, the listed keys that this one holds by mistake
by the third, and so on until a level makes no mistake. For every key asked for, the
levels in turn then give the true answer, so no url is joined with a list. All of it is expressions over columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.operators.bloom import MOST_WORDS, Bloom, build, words_for
from haulage.session import checkpointed

ACTIONS = ("block", "allow")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the keys not listed, one table of the first level lets through about one in 2^BITS_A_TABLE.
BITS_A_TABLE = 5
MOST_LEVELS = 64


@dataclass(frozen=True)
class UrlRule:
    """A host with all its subdomains, the start of a path, and `block` or `allow`."""

    host: str
    path: str
    action: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        """How many labels and how many characters of the path a url must show to be looked up."""
        return self.host.count(".") + 1, len(self.path)


@dataclass(frozen=True)
class Cascade:
    """Filters of listed keys and of mistakes in turn."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key is listed; exact for the keys that the cascade was built over."""
        found = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            found = F.when(self.levels[number - 1].may_hold(key), found).otherwise(F.lit(number % 2 == 0))
        return found


def cascade(listed: DataFrame, universe: DataFrame, size: int, bits_a_key: int = 16, salt: int = 0) -> Cascade:
    """The cascade of the keys in `listed` over those in `universe`, about `size` keys; both have a column `key`.

    The universe is read once and never shuffled: only what the first level lets through by mistake leaves a task. The tables of the first level follow the logarithm of universe to list, so that
    the mistakes are about as many as the listed keys, at any size of the universe. A list of more keys
    than a level of bounded size can hold is refused.
    """
    listed = checkpointed(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if n == 0:
        return Cascade((build(listed, "key", 1, salt=salt),))
    if n * bits_a_key > 64 * MOST_WORDS:
        raise ValueError(f"{n} listed keys; at most {64 * MOST_WORDS // bits_a_key} fit a level")
    tables = max(1, math.ceil(math.log2(max(1, size / n)) / BITS_A_TABLE))
    levels = [build(listed, "key", words_for(n, bits_a_key), tables, salt)]
    passed = universe.where(levels[0].may_hold(F.col("key"))).distinct()
    inside, outside = listed, checkpointed(passed.join(listed, "key", "left_anti"))
    while len(levels) < MOST_LEVELS:
        # What the level before lets through by mistake is the next one's list.
        n = outside.count()
        if n == 0:
            return Cascade(tuple(levels))
        if n * bits_a_key > 64 * MOST_WORDS:
            raise ValueError(f"a level lets {n} keys through by mistake; use more bits a key")
        levels.append(build(outside, "key", words_for(n, bits_a_key), salt=salt + len(levels)))
        inside, outside = outside, checkpointed(inside.where(levels[-1].may_hold(F.col("key"))))
    raise ValueError(f"still mistakes after {MOST_LEVELS} levels; use more bits a key")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first `://`, up to a slash, `?` or `#`, in lower case, and from there up to `?` or `#`.

    Both are empty for a url that is null or has no `://`.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def lookups(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """All that may be listed for a url: for each shape among the rules, the host's last labels and the path's start."""
    count = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + F.lit(1)
    found = []
    for labels, length in sorted({rule.shape for rule in rules}):
        end, start = F.substring_index(host, ".", -labels), F.substring(path, 1, length)
        fits = (count >= labels) & (F.length(path) >= length) & (host != "")
        one = F.struct(
            (F.length(end) + F.length(start)).alias("size"), F.length(end).alias("host"), F.concat(end, start).alias("key")
        )
        found.append(F.when(fits, one))
    return F.array_compact(F.array(*found))


def judge_urls(
    df: DataFrame,
    rules: Sequence[UrlRule],
    url: str = "url",
    default: str = "allow",
    bits_a_key: int = 16,
) -> DataFrame:
    """The rows of `df` with `host`, `path`, `rule` and `verdict`; columns of these names are replaced.

    A rule fits a url if the url's host is the rule's or a subdomain of it and the path starts with the rule's;
    of those that fit, the longest gives the verdict (of two as long, the one with the longer host), and none
    means `default` and a null rule. A null or empty url, or one without `://`, has an empty host, which no rule
    fits. Rows are judged by themselves: repeated rows and ids stay, nothing is shuffled for them. A
    table without rows gives none. A host is compared without case in the url; rules have theirs in lower case.
    """
    for rule in rules:
        if not rule.host or rule.action not in ACTIONS or rule.host != rule.host.translate(str.maketrans(UPPER, LOWER)):
            raise ValueError(f"not a rule: {rule}")
    actions = {}
    for rule in rules:
        if actions.setdefault(rule.key, rule.action) != rule.action:
            raise ValueError(f"{rule.key} is both blocked and allowed")
    host, path = host_and_path(df[url])
    if not rules:
        none = F.lit(None).cast("string")
        return df.withColumns({"host": host, "path": path, "rule": none, "verdict": F.lit(default)})

    spark = df.sparkSession
    asked = df.select(F.explode(lookups(host, path, rules)).alias("_")).select("_.key")
    size = asked.agg(F.approx_count_distinct("key")).first()[0]
    held = []
    for number, action in enumerate(ACTIONS):
        keys = [(key,) for key, what in actions.items() if what == action]
        listed = spark.createDataFrame(keys, "key string")
        held.append(cascade(listed, asked, size, bits_a_key, MOST_LEVELS * number))
    fit = F.filter(lookups(host, path, rules), lambda k: held[0].holds(k["key"]) | held[1].holds(k["key"]))
    rule = F.array_max(fit)["key"]
    verdict = F.when(rule.isNull(), F.lit(default)).when(held[0].holds(rule), F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumns({"host": host, "path": path, "rule": rule, "verdict": verdict})
