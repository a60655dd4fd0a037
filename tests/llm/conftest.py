import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog tonight.", "en", "src0"),
        (2, "THE QUICK brown fox jumps over the lazy dog tonight.", "en", "src1"),
        (3, None, None, None),
        (4, "", "de", "src0"),
        (5, "Ä", "de", None),
        (6, "ä", "de", "src0"),
        (7, long, "en", "src0"),
        (8, long, "en", "src0"),
        (9, "12345 67 !!! ...", None, "src2"),
        (9, "12345 67 !!! ...", None, "src2"),
        (10, "   \t\n ", "fr", "src0"),
        (11, "naïve \x1c café   <|endoftext|> it's 42", "fr", "src0"),
        (None, "a row without a number", "en", "src0"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = "fp long, key string, kept boolean, sequence_id string, raw binary, score string, word string, doc int, x int"
    df = spark.createDataFrame(rows, schema)
    for c in extra.split(", "):
        df = df.selectExpr("*", f"cast(null as {c.split()[1]}) as `{c.split()[0]}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (9, 0, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
