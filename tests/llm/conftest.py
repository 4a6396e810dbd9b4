import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and clashing column names."""
    rows = [
        (1, "The first text, which isn't long.", "en", "a", 5),
        (1, "The first text, which isn't long.", "en", "a", 5),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (None, "no id at all", "en", "a", 1),
        (4, " \t\n  ", "en", None, 4),
        (5, "word " * 20_000, "en", "a", 100_000),
        (6, "a" * 3000 + "ÄÖ漢字🙂 é  x\x1cy", "de", "b", 1),
        (7, "Twelve  numbers 123456789012 and    gaps\r\n", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "decoded", "fp", "size", "score", "start", "key", "part", "component", "h"):
        df = df.withColumn(name, df["n_chars"])
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [r["text"] or "" for r in df.collect()]
