import pytest

from haulage.llm.ship import ship

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))

#: Nulls, empty and blank texts, ties, copies, a repeated row, a very long text, odd characters.
ROWS = [
    (1, PASSAGE + " first ending here", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n\r\x0b\x0c ", "en"),
    (5, "Start of another text: " + PASSAGE, "de"),
    (6, "alpha beta gamma", "en"),
    (7, "alpha beta gamma", "en"),
    (7, "alpha beta gamma", "en"),
    (8, LONG, "en"),
    (None, "a text without an id, alpha beta", None),
    (9, "Ünïcödé   naïve　中文 👍 \x00 <|endoftext|> İΣ", "fr"),
    (10, "again and again and again and again and again and again and again", "en"),
    (11, PASSAGE, "en"),
]
COLUMNS = "doc_id long, text string, lang string"
#: Names that operators use for their own columns.
CLASHES = [
    "n_words", "score", "held_out", "predicted", "kept", "repeats", "fingerprint", "component_id", "start",
    "length", "ids", "n_tokens", "sequence_id", "offset", "anchor", "code", "mask", "block", "_text", "word", "n",
]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def odd(spark):
    """All odd rows, over two partitions, with columns of clashing names beside."""
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(2)
    return df.selectExpr("*", *(f"'x' AS {name}" for name in CLASHES))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 12)], "doc_id long, quality int, toxic int")
