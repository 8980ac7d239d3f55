"""Foreign keys over whole tables: existence, navigation and ON DELETE actions.

How a join is done is left to Catalyst and its adaptive execution, which sends a small side
to every task and splits a partition that a frequent key made large. It can split the side a
join keeps, and either side of an inner join, so joins are written that way round.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.types import named
from haulage.session import checkpointed

# Rounds of new keys that are kept apart before they are written as one.
MOST_PIECES = 8


@dataclass(frozen=True)
class ForeignKey:
    """``child.child_key`` refers to the unique ``parent.parent_key``."""

    child: str
    child_key: str
    parent: str
    parent_key: str
    on_delete: str = "cascade"

    def __post_init__(self) -> None:
        if self.on_delete not in ("cascade", "set null"):
            raise ValueError(f"unknown action {self.on_delete!r}")


def with_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key exists in the parent."""
    keys = parent.select(named(parent_key).alias("_parent_key"))
    return child.join(keys, child[key] == keys["_parent_key"], "left_semi")


def without_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is missing from the parent; NULL keys are kept."""
    keys = parent.select(named(parent_key).alias("_parent_key"))
    return child.join(keys, child[key] == keys["_parent_key"], "left_anti")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows that break the foreign key; a NULL key refers to nothing and is no violation."""
    return without_parent(child.where(named(key).isNotNull()), key, parent, parent_key)


def orphan_summary(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Missing parent keys and the child rows under each.

    Children are counted per key before the join: it sees each key once,
    however many rows refer to it.
    """
    refers = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return refers.join(
        parent.select(F.col(parent_key).alias("_parent_key")),
        F.col(key) == F.col("_parent_key"),
        "left_anti",
    )


def _named_apart(
    left: DataFrame, key: str, right: DataFrame, right_key: str
) -> tuple[DataFrame, list[Column]]:
    """The right side with its key out of the way, and the columns of a join of both.

    A key named alike on both sides appears once, as the left side's.
    """
    shared = set(left.columns) & set(right.columns) - {key if key == right_key else ""}
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}; rename or drop them")
    columns = [F.col(c) for c in left.columns]
    for c in right.columns:
        if c != right_key:
            columns.append(F.col(c))
        elif key != right_key:
            columns.append(F.col("_right_key").alias(c))
    return right.withColumnRenamed(right_key, "_right_key"), columns


def _matched_and_not(left: DataFrame, key: str, right: DataFrame, columns: list[Column]) -> DataFrame:
    """A left join as its matches and its rows without one, since only an inner join splits both sides."""
    condition = F.col(key) == F.col("_right_key")
    matched = left.join(right, condition)
    alone = left.join(right.select("_right_key"), condition, "left_anti")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return matched.select(columns).unionByName(alone.select("*", *missing).select(columns))


def look_up(child: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """Every child row with the columns of each reference row its key names, or NULLs."""
    reference, columns = _named_apart(child, key, reference, reference_key)
    return _matched_and_not(child, key, reference, columns)


def children_of(
    parent: DataFrame, parent_key: str, child: DataFrame, child_key: str
) -> DataFrame:
    """Every parent row with each of its children, or NULLs where it has none."""
    child, columns = _named_apart(parent, parent_key, child, child_key)
    return _matched_and_not(parent, parent_key, child, columns)


# --- ON DELETE ----------------------------------------------------------------


def _marked(rows: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """The rows with ``_gone``: whether their key names a deleted parent."""
    keys = deleted.select(named(deleted_key).alias("_gone_key")).where("_gone_key is not null").distinct()
    joined = rows.join(keys, rows[key] == keys["_gone_key"], "left")
    return joined.withColumn("_gone", F.col("_gone_key").isNotNull()).drop("_gone_key")


def null_deleted(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """ON DELETE SET NULL: every child row stays, references to deleted parents go."""
    data_type = child.schema[key].dataType
    kept = F.when(~F.col("_gone"), F.col(key)).cast(data_type).alias(key)
    marked = _marked(child, key, deleted, deleted_key)
    return marked.select(*[kept if c == key else F.col(c) for c in child.columns])


def rings(tables: Iterable[str], foreign_keys: Sequence[ForeignKey]) -> list[list[str]]:
    """Tables that refer to one another, directly or through others, as groups; parents' groups come first."""
    children: dict[str, set[str]] = {name: set() for name in tables}
    for fk in foreign_keys:
        children[fk.parent].add(fk.child)
    reached: dict[str, set[str]] = {}
    for name in children:
        found, ahead = set(), [name]
        while ahead:
            new = children[ahead.pop()] - found
            found |= new
            ahead += new
        reached[name] = found
    group = {name: min([name, *(other for other in reached[name] if name in reached[other])]) for name in children}
    order = TopologicalSorter({group[name]: set() for name in children})
    for fk in foreign_keys:
        if group[fk.child] != group[fk.parent]:
            order.add(group[fk.child], group[fk.parent])
    return [sorted(name for name in children if group[name] == head) for head in order.static_order()]


class _Deletion:
    """What a delete takes with it, held as the keys of deleted rows that other rows refer to."""

    def __init__(self, tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey], hit: dict[str, Column]) -> None:
        self.tables, self.hit = tables, hit
        self.cascades = [fk for fk in foreign_keys if fk.on_delete == "cascade"]
        self.nulls = [fk for fk in foreign_keys if fk.on_delete != "cascade"]
        self.referred = {name: sorted({fk.parent_key for fk in foreign_keys if fk.parent == name}) for name in tables}
        self.gone: dict[tuple[str, str], DataFrame] = {}

    def taken(self, fk: ForeignKey, keys: DataFrame) -> DataFrame:
        """The child's rows that refer to one of the parent's keys."""
        return with_parent(self.tables[fk.child], fk.child_key, keys, fk.parent_key)

    def keys_of(self, name: str, rows: Sequence[DataFrame], key: str) -> DataFrame:
        found = reduce(DataFrame.unionAll, [r.select(named(key)) for r in rows])
        return found.where(named(key).isNotNull()).distinct()

    def from_outside(self, name: str, group: Sequence[str]) -> list[DataFrame]:
        """Deleted rows of a table, as far as they follow from the condition and from tables outside its group."""
        found = [self.tables[name].where(self.hit[name])] if name in self.hit else []
        for fk in self.cascades:
            if fk.child == name and fk.parent not in group and (fk.parent, fk.parent_key) in self.gone:
                found.append(self.taken(fk, self.gone[fk.parent, fk.parent_key]))
        return found

    def follow(self, group: Sequence[str]) -> None:
        """Find the group's deleted keys. In a ring, each round looks only for rows that refer to the keys of the round before."""
        within = [fk for fk in self.cascades if fk.child in group and fk.parent in group]
        fresh: dict[tuple[str, str], DataFrame] = {}
        for name in group:
            rows = self.from_outside(name, group)
            for key in self.referred[name] if rows else ():
                keys = self.keys_of(name, rows, key)
                fresh[name, key] = checkpointed(keys) if within else keys
        if not within:
            self.gone |= fresh
            return
        pieces: dict[tuple[str, str], list[DataFrame]] = {}
        while fresh := {at: keys for at, keys in fresh.items() if not keys.isEmpty()}:
            for at, keys in fresh.items():
                pieces.setdefault(at, []).append(keys)
                if len(pieces[at]) > MOST_PIECES:
                    pieces[at] = [checkpointed(reduce(DataFrame.unionAll, pieces[at]))]
            found: dict[str, list[DataFrame]] = {}
            for fk in within:
                if (fk.parent, fk.parent_key) in fresh:
                    found.setdefault(fk.child, []).append(self.taken(fk, fresh[fk.parent, fk.parent_key]))
            fresh = {}
            for name, rows in found.items():
                for key in self.referred[name]:
                    keys = self.keys_of(name, rows, key)
                    if (name, key) in pieces:
                        known = reduce(DataFrame.unionAll, pieces[name, key])
                        keys = without_parent(keys, key, known, key)
                    fresh[name, key] = checkpointed(keys)
        self.gone |= {at: reduce(DataFrame.unionAll, held) for at, held in pieces.items()}

    def left(self, name: str) -> DataFrame:
        """The table afterwards: rows that neither the condition nor a deleted parent takes, references that were set to NULL gone."""
        rows = self.tables[name]
        if name in self.hit:
            rows = rows.where(~self.hit[name])
        for fk in (fk for fk in self.cascades if fk.child == name and (fk.parent, fk.parent_key) in self.gone):
            rows = without_parent(rows, fk.child_key, self.gone[fk.parent, fk.parent_key], fk.parent_key)
        for fk in (fk for fk in self.nulls if fk.child == name and (fk.parent, fk.parent_key) in self.gone):
            rows = null_deleted(rows, fk.child_key, self.gone[fk.parent, fk.parent_key], fk.parent_key)
        return rows


def delete_rows(
    tables: Mapping[str, DataFrame],
    foreign_keys: Sequence[ForeignKey],
    table: str,
    condition: Column,
) -> dict[str, DataFrame]:
    """All tables as they are after deleting the rows of one that meet a condition.

    Only the keys of deleted rows travel: tables are visited parents first, each one's deleted keys are
    found by semi-joins on its parents' and its rows are read again for what is left. Tables that refer to one another, or
    to themselves, are followed round by round until no new key turns up; a round's new keys are written to the shared
    folder, and the next one looks for rows that refer to those alone.
    """
    deletion = _Deletion(tables, foreign_keys, {table: F.coalesce(condition, F.lit(False))})
    for group in rings(tables, foreign_keys):
        deletion.follow(group)
    return {name: deletion.left(name) for name in tables}
