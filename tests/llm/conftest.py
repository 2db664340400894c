import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and columns whose names clash."""
    long = "a line that goes on " * 20_000
    rows = [(1, "The first text, long enough to be a line.", 0), (1, "The first text, long enough to be a line.", 0), (2, "", 1), (3, None, None), (None, "An id that is null, with a text.", 2), (4, "   \n\t ", 3), (5, long, 4), (6, "é́ Σίσυφος ΣΑΣ 😀 <|endoftext|> it's 3.14\x1cq", 5), (7, "short", None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, n, n, n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, k int, drop int, vid int")
    return df.withColumnRenamed("vid", "Text")
