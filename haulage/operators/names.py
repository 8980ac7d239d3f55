"""Names matched to the closest reference names within an edit distance.

Two texts within d edits share one of their q*d + 1 rarest q-grams, as an edit touches q grams at most (the prefix
filter). So each text is looked up by those alone, and only what shares one is compared. Texts too short to
have more than q*d grams are looked up by what is left of them without up to d characters. Every
text is worked through once, however many rows hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.types import named

START, END = "\u0002", "\u0003"


def grams(text: Column, q: int) -> Column:
    """All stretches of q characters of a text with marks around it, repeated ones numbered."""
    marked = F.concat(F.lit(START * (q - 1)), text, F.lit(END * (q - 1)))
    each = F.transform(F.sequence(F.lit(1), F.length(text) + (q - 1)), lambda i: F.substr(marked, i, F.lit(q)))
    numbered = F.transform(
        F.array(each),
        lambda a: F.transform(
            a, lambda x, i: F.concat(x, F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x)).cast("string"))
        ),
    )
    return F.get(numbered, 0)


def without_characters(text: Column, most: int) -> Column:
    """What a text leaves when up to `most` of its characters go."""
    found = F.array(text)
    for _ in range(most):
        fewer = F.transform(
            found,
            lambda t: F.transform(
                F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>")),
                lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t))),
            ),
        )
        found = F.array_distinct(F.concat(found, F.flatten(fewer)))
    return found


def _lookups(sides: DataFrame, most: int, q: int) -> DataFrame:
    """(side, text, at): by what each text is looked up."""
    long = (F.length("text") + (q - 1)) > q * most
    each = sides.select("side", "text", F.explode(grams(F.col("text"), q)).alias("gram"))
    # One row for each distinct gram; how often it occurs is added up before it is shuffled.
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    ranked = each.join(often, "gram").groupBy("side", "text").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("g"))
    rare = F.transform(F.slice("g", 1, q * most + 1), lambda x: x["gram"])
    by_gram = ranked.select("side", "text", F.explode(rare).alias("at"))
    rest = F.transform(without_characters(F.col("text"), most), lambda t: F.concat(F.lit(END + START), t))
    return by_gram.unionByName(sides.where(~long).select("side", "text", F.explode(rest).alias("at")))


def close_names(
    names: DataFrame, name: str, reference: DataFrame, reference_name: str, most: int = 2, q: int = 2
) -> DataFrame:
    """(name, reference_name, distance): all pairs of distinct texts within `most` edits; NULLs match nothing."""
    if most < 0 or q < 1:
        raise ValueError("the distance must be 0 or more and a gram one character or more")
    sides = [
        df.select(F.lit(side).alias("side"), named(c).cast("string").alias("text")).where("text is not null").distinct()
        for side, df, c in (("name", names, name), ("reference", reference, reference_name))
    ]
    lookups = _lookups(sides[0].unionByName(sides[1]), most, q)
    left = lookups.where("side = 'name'").select("at", F.col("text").alias("name"))
    right = lookups.where("side = 'reference'").select("at", F.col("text").alias("reference_name"))
    near = F.abs(F.length("name") - F.length("reference_name")) <= most
    pairs = left.join(right, "at").where(near).select("name", "reference_name").distinct()
    distance = F.levenshtein("name", "reference_name", most)
    return pairs.withColumn("distance", distance).where("distance >= 0")


def closest_name(
    child: DataFrame, key: str, reference: DataFrame, reference_key: str, most: int = 2, q: int = 2
) -> DataFrame:
    """Every child row with ``matched``, the closest reference name, and its ``distance``, or NULLs where none is near.

    Of names as close, the first in order is taken. Columns of these names must not be among the child's.
    """
    if clash := {"matched", "distance"} & set(child.columns):
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    pairs = close_names(child, key, reference, reference_key, most, q)
    best = pairs.groupBy("name").agg(F.min(F.struct("distance", "reference_name")).alias("_best"))
    joined = child.join(best.withColumnRenamed("name", "_name"), child[key].cast("string") == F.col("_name"), "left")
    return joined.select(
        *[child[c] for c in child.columns],
        F.col("_best.reference_name").alias("matched"),
        F.col("_best.distance").alias("distance"),
    )
