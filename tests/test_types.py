import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import (
    LANDING_TYPES,
    SourceColumn,
    ValueRules,
    columns_of,
    interval_nanos,
    landing_schema,
    landing_type,
    micros_from_nanos,
    parse_type,
)
from haulage.operators.conform import align, conform, mapping_report, stack_up, with_defaults
from tests.conftest import rows


def one(df):
    return df.collect()[0][0]


def landed(spark, expression, source_type, rules=ValueRules(), nullable=True):
    df = spark.sql(f"SELECT {expression} AS v")
    return conform(df, [SourceColumn("v", source_type, nullable)], rules)


def test_every_mapped_type_has_its_landing_type():
    assert len(LANDING_TYPES) == 16
    assert landing_type(SourceColumn("a", "SMALLINT")) == T.IntegerType()
    assert landing_type(SourceColumn("a", "Timestamp With Time Zone")) == T.TimestampNTZType()
    assert landing_type(SourceColumn("a", "uuid")) == T.StringType()


@pytest.mark.parametrize(
    "expression, source_type, expected",
    [
        ("'550e8400-e29b-41d4-a716-446655440000'", "uuid", "550e8400-e29b-41d4-a716-446655440000"),
        ("'2001:db8::1'", "inet", "2001:db8::1"),
        ("timestamp_ntz'1970-01-01 12:00:00'", "time without time zone", "12:00:00.000000"),
        ("interval '30' day", "interval", "2592000000000000"),
        ("'30 days'", "interval", "2592000000000000"),
        ("array('a', 'b')", "ARRAY", '["a","b"]'),
        ("array('a', null)", "ARRAY", '["a",null]'),
        ("cast(array() as array<string>)", "ARRAY", "[]"),
        ("named_struct('a', 1, 'b', named_struct('c', null))", "jsonb", '{"a":1,"b":{"c":null}}'),
        ("map('k', 1)", "jsonb", '{"k":1}'),
        ("parse_json('{\"k\": [1, 2]}')", "jsonb", '{"k":[1,2]}'),
        ("'{\"k\": 1}'", "jsonb", '{"k": 1}'),
        ("X'fffe00'", "bytea", "\\xfffe00"),
        ("cast(null as binary)", "bytea", None),
        ("cast(null as array<string>)", "ARRAY", None),
    ],
)
def test_unmapped_types_land_as_text(spark, expression, source_type, expected):
    df = landed(spark, expression, source_type)
    assert df.schema["v"].dataType == T.StringType()
    assert one(df) == expected


def test_interval_may_stay_text(spark):
    assert one(landed(spark, "'30 days'", "interval", ValueRules(interval_as_text=True))) == "30 days"


@pytest.mark.parametrize(
    "text, delta",
    [
        ("1 year 2 mons 3 days 04:05:06.7", dt.timedelta(days=428, hours=4, minutes=5, seconds=6.7)),
        ("-3 days -00:00:01", -dt.timedelta(days=3, seconds=1)),
        ("0 years 0 mons 30 days 1 hours -2 mins 3.5 secs", dt.timedelta(30, 3483.5)),
        ("1 mon", dt.timedelta(days=30)),
        ("00:00:00.000001", dt.timedelta(microseconds=1)),
        ("1 day", dt.timedelta(days=1)),
        ("00:00:00", dt.timedelta()),
    ],
)
def test_interval_text_in_nanoseconds(spark, text, delta):
    df = spark.createDataFrame([(text,)], "v string").select(interval_nanos(F.col("v")))
    assert one(df) == (delta // dt.timedelta(microseconds=1)) * 1000


def test_native_nested_types_on_request(spark):
    df = landed(spark, "array('a')", "ARRAY", ValueRules(native_nested=True))
    assert one(df) == ["a"]


@pytest.mark.parametrize(
    "nanos, expected",
    [
        (1_700_000_000_999_999_999, dt.datetime(2023, 11, 14, 22, 13, 20, 999999)),
        (-1, dt.datetime(1969, 12, 31, 23, 59, 59, 999999)),
        (-1000, dt.datetime(1969, 12, 31, 23, 59, 59, 999999)),
        (999, dt.datetime(1970, 1, 1)),
        (None, None),
    ],
)
def test_nanoseconds_are_cut_not_rounded(spark, nanos, expected):
    df = spark.createDataFrame([(nanos,)], "v bigint").select(micros_from_nanos(F.col("v")))
    assert one(df) == expected


def test_timestamptz_lands_as_utc_wall_clock(spark):
    df = landed(spark, "timestamp'2024-06-01 12:00:00+02:00'", "timestamp with time zone")
    assert one(df) == dt.datetime(2024, 6, 1, 10)
    assert df.schema["v"].dataType == T.TimestampNTZType()


def test_nan_lands_as_null_unless_asked_otherwise(spark):
    assert one(landed(spark, "double('NaN')", "double precision")) is None
    assert one(landed(spark, "float('NaN')", "real")) is None
    kept = one(landed(spark, "double('NaN')", "double precision", ValueRules(nan_to_null=False)))
    assert kept != kept


def test_large_integers_stay_exact_beside_null(spark):
    df = spark.createDataFrame([(2**53 + 1,), (None,)], "v bigint")
    assert rows(conform(df, [SourceColumn("v", "bigint")])) == [(None,), (2**53 + 1,)]


@pytest.mark.parametrize(
    "expression, source_type",
    [
        ("2147483648L", "integer"),
        ("1.5D", "integer"),
        ("1.5BD", "bigint"),
        ("double('NaN')", "integer"),
        ("9007199254740993L", "double precision"),
        ("16777217", "real"),
    ],
)
def test_a_cast_that_would_change_the_value_fails(spark, expression, source_type):
    with pytest.raises(Exception, match="cannot hold exactly"):
        landed(spark, expression, source_type, ValueRules(nan_to_null=False)).collect()


def test_money_is_double_or_exact(spark):
    column = SourceColumn("v", "numeric", True, 15, 2)
    df = spark.sql("SELECT 12.34BD AS v")
    assert conform(df, [column]).schema["v"].dataType == T.DoubleType()
    exact = conform(df, [column], ValueRules(exact_decimal=True))
    assert exact.schema["v"].dataType == T.DecimalType(15, 2)


def test_required_column_fails_the_job_on_null(spark):
    good = landed(spark, "1", "integer", nullable=False)
    assert one(good) == 1
    with pytest.raises(Exception, match="column v must not be NULL"):
        landed(spark, "cast(null as int)", "integer", nullable=False).collect()
    with pytest.raises(Exception, match="column v must not be NULL"):
        landed(spark, "double('NaN')", "double precision", nullable=False).collect()


def test_align_permutes_narrows_and_guards(spark):
    target = T.StructType(
        [T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType(), False)]
    )
    df = spark.createDataFrame([(1, "x")], "a bigint, b string")
    aligned = align(df, target)
    assert aligned.columns == ["b", "a"] and aligned.schema["a"].dataType == T.IntegerType()
    with pytest.raises(ValueError, match="missing"):
        align(df.drop("b"), target)
    with pytest.raises(ValueError, match="unexpected"):
        align(df.withColumn("c", F.lit(1)), target)
    with pytest.raises(Exception, match="cannot hold exactly"):
        align(spark.createDataFrame([(2**31, "x")], "a bigint, b string"), target).collect()
    with pytest.raises(Exception, match="must not be NULL"):
        align(spark.createDataFrame([(None, "x")], "a bigint, b string"), target).collect()


def test_defaults_fill_omitted_columns_only(spark):
    df = spark.createDataFrame([(1, None)], "a int, status string")
    filled = with_defaults(df, {"status": F.lit("active"), "currency": F.lit("USD")})
    assert rows(filled) == [(1, None, "USD")]


def test_mapping_report_counts_fallback_values(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "a int, tags array<string>")
    report = rows(mapping_report(df, columns_of(df)))
    assert report == [
        (1, "a", "integer", "int", True, 2, 0),
        (2, "tags", "array", "string", False, 1, 1),
    ]


def test_landing_schema_keeps_declared_nullability(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    schema = landing_schema(
        [SourceColumn("a", "integer", False), SourceColumn("b", "text")], ValueRules(), df.schema
    )
    assert [f.nullable for f in schema] == [False, True]


def test_parse_type():
    assert parse_type("numeric(15,2)") == ("numeric", 15, 2)
    assert parse_type("CHARACTER VARYING(20)") == ("character varying", 20, None)
    assert parse_type("timestamp with time zone") == ("timestamp with time zone", None, None)


def test_stack_up_keeps_duplicates(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(stack_up([df, df.select("b", "a")]), "a", "b") == [(1, "x"), (1, "x")]
