"""Source types, the type each lands as, and how single values are converted."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source type names with a declared landing type. Every other
# source type lands as a string.
LANDING_TYPES: dict[str, T.DataType] = {
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.IntegerType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "numeric": T.DoubleType(),
    "decimal": T.DoubleType(),
    "text": T.StringType(),
    "character varying": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "character": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampNTZType(),
}

# Largest whole number every smaller one of which the type holds exactly.
EXACT_WHOLE_NUMBERS = {"float": 2**24, "double": 2**53}

NANOSECOND_TIMESTAMP = "timestamp(9) without time zone"


@dataclass(frozen=True)
class SourceColumn:
    """One column of a source table as its catalog describes it."""

    name: str
    source_type: str
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None

    @property
    def type_name(self) -> str:
        """The type's name in lower case; timestamps by their long name, without digits that fit a microsecond."""
        name = " ".join(self.source_type.strip().lower().split())
        found = re.fullmatch(r"timestamp(tz)?\s*(?:\(([0-6])\))?(?:\s*(with|without) time zone)?", name)
        if not found:
            return name
        return f"timestamp {'with' if found[1] or found[3] == 'with' else 'without'} time zone"


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ValueRules:
    """Choices about how values land; the defaults follow the documented behaviour."""

    exact_decimal: bool = False
    nan_to_null: bool = True
    interval_as_text: bool = False
    native_nested: bool = False
    json_as_variant: bool = False


def landing_type(
    column: SourceColumn, rules: ValueRules = ValueRules(), arrives_as: T.DataType | None = None
) -> T.DataType:
    """The type a source column has in the target table."""
    name = column.type_name
    if name == NANOSECOND_TIMESTAMP:
        return T.TimestampNTZType()
    if rules.exact_decimal and name in {"numeric", "decimal"}:
        if column.precision is not None:
            return T.DecimalType(column.precision, column.scale or 0)
        if isinstance(arrives_as, T.DecimalType):
            return arrives_as
    if rules.json_as_variant and name in {"json", "jsonb"}:
        return T.VariantType()
    if rules.native_nested and isinstance(arrives_as, (T.ArrayType, T.StructType, T.MapType)):
        return arrives_as
    return LANDING_TYPES.get(name, T.StringType())


def is_mapped(column: SourceColumn) -> bool:
    return column.type_name in LANDING_TYPES or column.type_name == NANOSECOND_TIMESTAMP


def source_type_of(data_type: T.DataType) -> tuple[str, int | None, int | None]:
    """Catalog name, precision and scale for the type of a file column."""
    if isinstance(data_type, T.DecimalType):
        return "numeric", data_type.precision, data_type.scale
    names = {
        T.ByteType: "smallint",
        T.ShortType: "smallint",
        T.IntegerType: "integer",
        T.LongType: "bigint",
        T.FloatType: "real",
        T.DoubleType: "double precision",
        T.StringType: "text",
        T.BooleanType: "boolean",
        T.DateType: "date",
        T.TimestampNTZType: "timestamp without time zone",
        T.TimestampType: "timestamp with time zone",
        T.BinaryType: "bytea",
        T.DayTimeIntervalType: "interval",
        T.ArrayType: "array",
        T.StructType: "jsonb",
        T.MapType: "jsonb",
        T.VariantType: "jsonb",
    }
    return names.get(type(data_type), data_type.simpleString()), None, None


def columns_of(df: DataFrame) -> list[SourceColumn]:
    """Describe a DataFrame's columns the way a database catalog would, in order."""
    described = []
    for field in df.schema.fields:
        name, precision, scale = source_type_of(field.dataType)
        described.append(SourceColumn(field.name, name, field.nullable, precision, scale))
    return described


def parse_type(text: str) -> tuple[str, int | None, int | None]:
    """Split ``numeric(15,2)`` into its name, precision and scale."""
    found = re.fullmatch(r"\s*([^()]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    if not found:
        return text.strip().lower(), None, None
    name, precision, scale = found.groups()
    return name.lower(), int(precision) if precision else None, int(scale) if scale else None


# --- single values -----------------------------------------------------------


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def wall_clock(micros: Column) -> Column:
    """Microseconds since the epoch as a UTC wall clock, whatever the session's time zone."""
    return F.timestamp_add("MICROSECOND", micros, epoch())


def interval_micros(interval: Column) -> Column:
    """Microseconds in a day-time interval."""
    seconds = interval.cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def wall_clock_micros(clock: Column) -> Column:
    """Microseconds from the epoch to a wall clock, both read as UTC."""
    return interval_micros(clock - epoch())


def micros_from_nanos(nanos: Column) -> Column:
    """Nanoseconds since the epoch to a timestamp, cut down to the microsecond.

    The remainder is taken non-negative first: plain integer division rounds
    towards zero and would move instants before 1970 forwards.
    """
    whole = nanos - F.pmod(nanos, F.lit(1000))
    return wall_clock(F.call_function("div", whole, F.lit(1000)))


def nan_as_null(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def required(value: Column, name: str, data_type: T.DataType) -> Column:
    """The value itself, or a failed job where it is NULL.

    It only fires in a plan that uses the column, so it belongs into the
    projection that is written.
    """
    message = F.lit(f"column {name} must not be NULL")
    return F.coalesce(value, F.raise_error(message).cast(data_type))


# Seconds in each unit, by the first letters of its name, and by its letter behind `P` and `T`
# with `n` for a minute. A month counts 30 days and a year 365.
UNIT_SECONDS = {
    "ye": 31_536_000, "mo": 2_592_000, "we": 604_800, "da": 86_400, "ho": 3_600, "mi": 60, "se": 1,
    "y": 31_536_000, "m": 2_592_000, "w": 604_800, "d": 86_400, "h": 3_600, "n": 60, "s": 1,
}


VALUE = r"[+-]?\d+(?:\.\d{1,6})?"
UNIT = r"(?:years?|mon(?:th)?s?|weeks?|days?|hours?|min(?:ute)?s?|sec(?:ond)?s?)(?![a-z])"
CLOCK = r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d{1,6})?))?"
DATES, TIMES = ("".join(f"(?:{VALUE}{unit})?" for unit in units) for units in ("YMWD", "HMS"))


def _clock(group: int) -> str:
    return f"coalesce(cast(nullif(regexp_extract(t, r'{CLOCK}', {group}), '') AS decimal(18,6)), 0)"


# A function of the text t to seconds. Both forms become amounts with short units, s: behind `P`, months and minutes
# differ by where they stand.
INTERVAL_SECONDS = rf"""
    t -> if(t IS NULL, NULL, transform(
        array(if(t LIKE 'P%',
            concat(translate(substring_index(t, 'T', 1), 'PYMWD', ' ymwd'),
                   if(contains(t, 'T'), translate(substring_index(t, 'T', -1), 'HMS', 'hns'), '')),
            lower(t))),
        s -> if(
            if(t LIKE 'P%', t RLIKE r'^P(?=.){DATES}(?:T(?=.){TIMES})?$',
               t RLIKE r'(?i)^\s*(?=\S)(?:{VALUE}\s*{UNIT}\s*)*(?:{CLOCK}\s*)?(?:ago\s*)?$' AND t RLIKE r'\d'),
            if(s RLIKE r'ago\s*$', -1, 1) * (
                aggregate(
                    zip_with(
                        regexp_extract_all(s, r'({VALUE})\s*([a-z]{{1,2}})[a-z]*', 1),
                        regexp_extract_all(s, r'({VALUE})\s*([a-z]{{1,2}})[a-z]*', 2),
                        (amount, unit) -> cast(amount AS decimal(18,6))
                            * try_element_at(map({", ".join(f"'{u}', {n}" for u, n in UNIT_SECONDS.items())}), unit)),
                    cast(0 AS decimal(38,6)),
                    (total, one) -> cast(total + one AS decimal(38,6)))
                + if(contains(t, ':'), if(regexp_extract(t, r'{CLOCK}', 1) = '-', -1, 1)
                     * (({_clock(2)} * 60 + {_clock(3)}) * 60 + {_clock(4)}), 0)),
            cast(raise_error(concat('cannot read the interval ', t)) AS decimal(38,6))))[0])
"""


def interval_nanos(text: Column) -> Column:
    """Nanoseconds in an interval written as ``1 year 2 mons 3 days 04:05:06.7``.

    The time may be spelled out as well, as in ``4 hours 5 mins 6.7 secs``, or have no
    seconds; ``2 weeks``, ``1 day ago`` and ``P1DT2H`` are read too. A month counts 30 days
    and a year 365, the usual conversion to a duration. Any other text fails the job.

    A value is checked by the expression of its own form and then cut into amounts and units once.
    """
    seconds = F.get(F.call_function("transform", F.array(text), F.expr(INTERVAL_SECONDS)), 0)
    return (seconds * 1_000_000_000).cast("bigint")


def as_text(value: Column, column: SourceColumn, arrives_as: T.DataType, rules: ValueRules) -> Column:
    """Text form of a value whose source type has no landing type of its own."""
    name = column.type_name
    if isinstance(arrives_as, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(arrives_as, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(arrives_as, T.VariantType):
        return F.to_json(value)
    clock = re.fullmatch(r"time(tz)?\s*(\(\d\))?(\s*with(out)? time zone)?", name)
    if clock and isinstance(arrives_as, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "HH:mm:ss.SSSSSS")
    if name == "interval" and not rules.interval_as_text:
        if isinstance(arrives_as, T.DayTimeIntervalType):
            return (interval_micros(value) * 1000).cast("string")
        if isinstance(arrives_as, T.StringType):
            return interval_nanos(value).cast("string")
    return value.cast("string")


def as_variant(value: Column, arrives_as: T.DataType) -> Column:
    """JSON parsed once, as it lands. Text that is not JSON fails the job."""
    if isinstance(arrives_as, T.VariantType):
        return value
    if isinstance(arrives_as, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_variant_object(value)
    return F.parse_json(value.cast("string"))


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def never_fails(arrives_as: T.DataType, lands_as: T.DataType) -> bool:
    """Whether every value of one type has its place in the other."""
    if isinstance(lands_as, T.StringType):
        return True
    if isinstance(arrives_as, WHOLE) and isinstance(lands_as, WHOLE):
        return WHOLE.index(type(arrives_as)) <= WHOLE.index(type(lands_as))
    return isinstance(lands_as, T.DoubleType) and isinstance(arrives_as, (*WHOLE[:3], *FRACTIONAL))


def safe_cast(value: Column, name: str, arrives_as: T.DataType, lands_as: T.DataType) -> Column:
    """A cast that fails the job instead of changing a value.

    Refused are values out of range or not readable, a fraction dropped on the
    way to a whole number or to fewer digits, a time of day dropped on the way to a date, and a
    whole number too large for a float to hold. It does not depend on the session's ANSI or
    time zone settings.
    """
    if arrives_as == lands_as:
        return value
    if isinstance(arrives_as, T.TimestampType) and isinstance(lands_as, T.TimestampNTZType):
        return wall_clock(F.unix_micros(value))
    if never_fails(arrives_as, lands_as):
        return value.cast(lands_as)
    cast = value.try_cast(lands_as)
    refused = value.isNotNull() & cast.isNull()
    if isinstance(lands_as, WHOLE) and isinstance(arrives_as, T.DecimalType):
        refused = refused | (value != F.floor(value))
    elif isinstance(lands_as, WHOLE) and isinstance(arrives_as, FRACTIONAL):
        refused = refused | (value != F.rint(value))
    elif isinstance(lands_as, T.DecimalType) and isinstance(arrives_as, T.DecimalType):
        refused = refused | (value != cast)
    elif isinstance(lands_as, T.DateType) and isinstance(arrives_as, (T.TimestampType, T.TimestampNTZType)):
        refused = refused | (cast.cast(arrives_as) != value)
    elif isinstance(lands_as, T.FloatType) and isinstance(arrives_as, T.DoubleType):
        refused = refused | ((F.abs(cast) == float("inf")) & (F.abs(value) != float("inf")))
    elif isinstance(arrives_as, WHOLE) and lands_as.typeName() in EXACT_WHOLE_NUMBERS:
        limit = EXACT_WHOLE_NUMBERS[lands_as.typeName()]
        refused = refused | ~value.between(-limit, limit)
    message = F.concat(F.lit(f"column {name} cannot hold exactly: "), value.cast("string"))
    return F.when(refused, F.raise_error(message).cast(lands_as)).otherwise(cast)


def land(value: Column, column: SourceColumn, arrives_as: T.DataType, rules: ValueRules) -> Column:
    """The expression that turns one source column into its target column."""
    lands_as = landing_type(column, rules, arrives_as)
    if column.type_name == NANOSECOND_TIMESTAMP and isinstance(arrives_as, T.LongType):
        landed = micros_from_nanos(value)
    elif isinstance(lands_as, T.VariantType):
        landed = as_variant(value, arrives_as)
    elif not is_mapped(column) and isinstance(lands_as, T.StringType):
        landed = as_text(value, column, arrives_as, rules)
    else:
        if rules.nan_to_null and isinstance(arrives_as, (T.FloatType, T.DoubleType)):
            value = nan_as_null(value)
        landed = safe_cast(value, column.name, arrives_as, lands_as)
    if not column.nullable:
        landed = required(landed, column.name, lands_as)
    return landed.alias(column.name)


def landing_schema(
    columns: Sequence[SourceColumn], rules: ValueRules, arrives_as: T.StructType
) -> T.StructType:
    """Schema of the target table, with the nullability the source declares."""
    return T.StructType(
        [
            T.StructField(c.name, landing_type(c, rules, arrives_as[c.name].dataType), c.nullable)
            for c in columns
        ]
    )
