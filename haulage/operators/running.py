"""Running values per key that survive one key holding a third of all rows.

Rows go through a range exchange by key and order, so a stretch holds rows that follow one another, whatever
the keys look like. Each stretch is worked through by itself and written once. Only its last key can
go on in the next stretch: one row a stretch is handed forward, and a stretch's first key adds what it was handed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from haulage.functions.types import named
from haulage.operators.skew import task_count
from haulage.session import checkpointed

# An amount as the source declares it; totals get ten digits more, balances another three.
AMOUNT = "decimal(15,2)"
TOTAL = "decimal(25,2)"
MONEY = "decimal(28,2)"

# The row within its partition, in what monotonically_increasing_id gives.
ROW_BITS = 33


def ranged(df: DataFrame, order: Sequence[str], parts: int, name: str = "_part") -> DataFrame:
    """The rows dealt to `parts` stretches of an order, with each one's stretch; all of a lower stretch come first.

    Spark draws the cuts from a sample of bounded size. The numbers hold for this exchange alone, so whatever
    needs them twice must write them first.
    """
    cut = df.repartitionByRange(parts, *[named(c) for c in order])
    return cut.withColumn(name, F.spark_partition_id())


def running_values(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    move: Column,
    *,
    before: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Rows with ``_count``, ``_total`` and ``_low`` per key, in an order unique within it.

    A NULL move counts as nothing. Rows without a key make a group like any other. ``before`` holds
    what a key starts from, a row each: ``_key``, ``_counts``, ``_move`` (its total) and ``_lowest``.
    """
    parts = parts or task_count(df)
    nothing = F.lit(0).cast(AMOUNT)
    # A struct is never NULL, so a NULL key partitions and joins like the rest.
    moved = df.withColumns(
        {
            "_key": F.struct(named(key).alias("k")),
            "_move": F.coalesce(move.cast(AMOUNT), nothing).cast(TOTAL),
            "_counts": F.lit(1).cast("bigint"),
            "_lowest": F.lit(None).cast(TOTAL),
            "_own": F.lit(True),
        }
    )
    if before is not None:
        # What a key starts from travels with its rows, ahead of them, so no join has to find it.
        moved = before.withColumn("_own", F.lit(False)).unionByName(moved, allowMissingColumns=True)
    sequence = ["_own", *order] if before is not None else list(order)
    # The windows find each stretch whole in a task; the exchange between moves it there unsplit.
    cut = ranged(moved, ["_key", *sequence], parts).repartitionById(parts, "_part")
    upto = Window.partitionBy("_part", "_key").orderBy(*[named(c) for c in sequence])
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({"_count": F.sum("_counts").over(upto), "_total": F.sum("_move").over(upto).cast(TOTAL)})
    local = local.withColumn("_low", F.min(F.when(F.col("_own"), F.col("_total")).otherwise(F.col("_lowest"))).over(upto))
    local = checkpointed(local.select(*df.columns, "_part", "_key", "_own", "_count", "_total", "_low"))
    handed = _handed_forward(local, sequence)
    joined = local.join(handed, ["_part", "_key"], "left")
    if before is not None:
        joined = joined.where("_own")
    so_far = F.coalesce("_total_before", F.lit(0).cast(TOTAL))
    return joined.select(
        *[named(c) for c in df.columns],
        (F.col("_count") + F.coalesce("_count_before", F.lit(0))).alias("_count"),
        (F.col("_total") + so_far).cast(TOTAL).alias("_total"),
        F.least("_low_before", (F.col("_low") + so_far).cast(TOTAL)).alias("_low"),
    )


def _handed_forward(local: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """(_part, _key, _count_before, _total_before, _low_before) of each stretch whose first key began in one before.

    One row a stretch: its first key, and its last key with the values at the stretch's end.
    """
    last = F.struct("_key", *[named(c) for c in sequence])
    ends = local.groupBy("_part").agg(
        F.min("_key").alias("_key"),
        F.max_by(F.struct("_key", "_count", "_total", "_low"), last).alias("_end"),
    )
    upto = Window.partitionBy("_end._key").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_t", F.sum("_end._total").over(upto).cast(TOTAL))
    low = (F.col("_t") - F.col("_end._total") + F.col("_end._low")).cast(TOTAL)
    so_far = F.struct(
        F.col("_end._key").alias("key"),
        F.sum("_end._count").over(upto).alias("count"),
        F.col("_t").alias("total"),
        F.min(low).over(upto).alias("low"),
    )
    ends = ends.select("_part", "_key", so_far.alias("_so_far"))
    ends = ends.withColumn("_handed", F.lag("_so_far").over(Window.orderBy("_part")))
    return ends.where("_handed.key = _key").select(
        "_part",
        "_key",
        F.col("_handed.count").alias("_count_before"),
        F.col("_handed.total").alias("_total_before"),
        F.col("_handed.low").alias("_low_before"),
    )


@dataclass(frozen=True)
class Opening:
    """Opening balances kept in a table of their own, one row per account."""

    accounts: DataFrame
    key: str
    balance: str

    def rows(self, kind: DataType) -> DataFrame:
        """Each account's balance as what it starts from."""
        nothing = F.lit(0).cast(AMOUNT)
        return self.accounts.where(named(self.key).isNotNull()).select(
            F.struct(named(self.key).cast(kind).alias("k")).alias("_key"),
            F.coalesce(named(self.balance).cast(AMOUNT), nothing).cast(TOTAL).alias("_move"),
            F.lit(0).cast("bigint").alias("_counts"),
            F.lit(None).cast(TOTAL).alias("_lowest"),
        )


def ledger(
    df: DataFrame,
    *,
    account: str,
    order: Sequence[str],
    kind: str,
    amount: str,
    credits: Sequence[str],
    debits: Sequence[str],
    opening: Column | Opening,
    parts: int | None = None,
) -> DataFrame:
    """Replay movements per account: credits add, debits subtract, never below zero.

    Flooring at every step is a fold, yet it has a closed form. With the
    unfloored total S, starting from the opening balance, every unit the floor
    ever gave back is the deepest S went below zero so far:
    balance = S - least(0, lowest S so far).

    A NULL amount moves nothing. A kind in neither list, or none, fails the job.
    ``opening`` is a column of the rows (one value per account) or a table;
    without an opening balance an account starts from nothing.
    """
    rules = Movements(account, tuple(order), kind, amount, tuple(credits), tuple(debits))
    return rules.replay(df, opening, parts=parts)[0]


@dataclass(frozen=True)
class Movements:
    """Which columns of a table are whose movements, in which order, and which kinds add or subtract."""

    account: str
    order: Sequence[str]
    kind: str
    amount: str
    credits: Sequence[str]
    debits: Sequence[str]

    def __post_init__(self) -> None:
        both = set(self.credits) & set(self.debits)
        if both:
            raise ValueError(f"kinds {sorted(both)} are both credits and debits")

    @property
    def signed(self) -> Column:
        value, which = named(self.amount).cast(AMOUNT), named(self.kind)
        shown = F.coalesce(which.cast("string"), F.lit("NULL"))
        unknown = F.raise_error(F.concat(F.lit("neither a credit nor a debit: "), shown)).cast(AMOUNT)
        adds, takes = which.isin(list(self.credits)), which.isin(list(self.debits))
        return F.when(adds, value).when(takes, -value).otherwise(unknown)

    def replay(
        self,
        df: DataFrame,
        opening: Column | Opening,
        state: DataFrame | None = None,
        parts: int | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """The movements with their balances, and each account's state behind its last one.

        A state is an account's ``count`` of movements, their ``total``, the ``lowest`` total there was and the ``last``
        movement's place in the order; two stretches of movements merge by (count + count', total + total',
        least(lowest, total + lowest')). With the ``state`` of all movements before, only new ones are read, and only
        states of accounts that have any travel with them. A movement that comes before the last one of its account's
        state, or is that one, fails the job. ``opening`` must be the same for every load.
        """
        place = F.struct(*[named(c) for c in self.order])
        before = opening.rows(df.schema[self.account].dataType) if isinstance(opening, Opening) else None
        if state is not None:
            firsts = df.groupBy(F.struct(named(self.account).alias("k")).alias("_key")).agg(F.min(place).alias("_first"))
            held = state.withColumn("_key", F.struct(named(self.account).alias("k")))
            late = F.raise_error(F.lit("a movement comes before one that was replayed")).cast("boolean")
            known = held.join(firsts, "_key").where(F.when(F.col("_first") > F.col("last"), F.lit(True)).otherwise(late))
            carried = known.select("_key", F.col("total").alias("_move"), F.col("count").alias("_counts"), F.col("lowest").alias("_lowest"))
            before = carried.unionByName(before.join(held, "_key", "left_anti")) if before is not None else carried
        rows = running_values(df, self.account, self.order, self.signed, before=before, parts=parts)
        behind = rows.groupBy(named(self.account)).agg(
            F.max("_count").alias("count"),
            F.max_by("_total", "_count").alias("total"),
            F.min("_low").alias("lowest"),
            F.max(place).alias("last"),
        )
        if state is not None:
            moved = behind.select(F.struct(named(self.account).alias("k")).alias("_key"))
            behind = behind.unionByName(held.join(moved, "_key", "left_anti").drop("_key"))
        nothing = F.lit(0).cast(AMOUNT)
        start = nothing if isinstance(opening, Opening) else F.coalesce(opening.cast(AMOUNT), nothing)
        total = start + F.col("_total")
        low = F.least(nothing, start + F.col("_low"))
        balances = rows.select(
            *[named(c) for c in df.columns],
            F.col("_count").alias("position"),
            total.cast(MONEY).alias("unfloored_balance"),
            (total - low).cast(MONEY).alias("balance_after"),
        )
        return balances, behind


def ledger_mismatches(replayed: DataFrame, stored: str, cent: str = "0.01") -> DataFrame:
    """Rows whose stored balance is off the replay by more than a cent per step so far.

    Each stored balance was rounded before the next step used it, so a
    difference of up to one cent may build up at every step.
    """
    off = F.abs(F.col(stored).cast(MONEY) - F.col("balance_after"))
    allowed = F.lit(cent).cast("decimal(3,2)") * F.col("position")
    return replayed.withColumn("difference", off.cast(MONEY)).where(
        F.col(stored).isNull() | (F.col("difference") > allowed)
    )


def running_count(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    name: str = "running_count",
    parts: int | None = None,
) -> DataFrame:
    """How many rows of its key there are up to and including each row."""
    counted = running_values(df, key, order, F.lit(0), parts=parts)
    return counted.select(*[named(c) for c in df.columns], F.col("_count").alias(name))


def flag_first(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "is_primary"
) -> DataFrame:
    """Mark each key's first row by a column that is never NULL and unique within the key.

    The first row is a minimum, which combines map-side, and the join back is on
    key and order together, which are unique: no key is ever gathered whole.
    """
    named = {key: f"_key_{key}" for key in keys}
    firsts = df.groupBy(*[F.col(key).alias(new) for key, new in named.items()])
    firsts = firsts.agg(F.min(order).alias("_first"))
    same = df[order] == firsts["_first"]
    for key, new in named.items():
        same = same & df[key].eqNullSafe(firsts[new])
    marked = df.join(firsts, same, "left")
    return marked.select(*df.columns, F.col("_first").isNotNull().alias(name))


def turned_away(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows a UNIQUE constraint refuses when rows arrive in order: all but each key's first.

    A key with a NULL in it equals no other, so it is never refused.
    """
    whole = df
    for key in keys:
        whole = whole.where(F.col(key).isNotNull())
    return flag_first(whole, keys, order, "_kept").where(~F.col("_kept")).drop("_kept")


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str = "row_id",
    start: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """Number all rows without gaps in a unique order, as a serial key does.

    A window over the whole table would sort it in one task. A range exchange deals out stretches of
    the order instead; each is sorted and its rows get their places in it as they are written. The stretches' sizes
    are added up, one row for each, and every row adds what lies before its stretch.
    """
    sequence = [named(c) for c in order]
    cut = ranged(df, order, parts or task_count(df), "_part").drop("_part")
    placed = cut.sortWithinPartitions(*sequence).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("_part", F.shiftright("_at", ROW_BITS))
    # One row per stretch: enough for a single task.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(starts, "_part").select(
        *[named(c) for c in df.columns], (within + F.col("_before") + F.lit(start)).alias(name)
    )
