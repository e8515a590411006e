import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use itself.
CLASHING = ("key", "rep", "band", "slot", "place", "gone", "line", "lines", "rank", "score", "n", "component", "batch", "ids", "host", "scores", "kept", "rows", "removed", "id")


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties, and repeated rows."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 5), (4, "one", "en", "a", 3), (5, "one", "en", "b", 3),
        (6, "the same line of text here\n" * 3, "en", "a", 81), (6, "the same line of text here\n" * 3, "en", "a", 81), (7, "x" * 300_000, "en", None, 300_000),
        (8, "word " * 40_000, "de", "b", 200_000), (None, "a text without an id, but with some words in it", "en", "a", 47), (None, None, None, None, None),
        (9, "mail me at a.b@example.com or 10.0.0.1\nçé日本😀 ▁ end", "fr", "a", 50), (6, "another text of the same id", "en", "c", 27),
    ]
    df = spark.createDataFrame(rows, ODD)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def some(spark):
    """Real documents, enough for groups of copies."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
